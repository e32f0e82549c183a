"""Items that appear together: basket collapsing.

Baskets with the same deduplicated items are grouped into one with a weight; the pairs of a
distinct basket are enumerated once and the weights are added up. An item in fewer than
``min_count`` baskets cannot be in a pair that occurs so often; such items are left out
before the baskets are formed, which loses no pair of the result and lets many more baskets
coincide. Baskets over ``block`` items are cut by hash into blocks of about that size, without being
held in one row; a row per pair of blocks is spread over the cluster, so a basket of any length is no
single task's work. Of such a basket the equal pairs of blocks are grouped, which collapses equal baskets too.

Edge cases: null and empty items are none; a basket with under two items gives no pair; an
item twice in a basket counts once; rows of one basket may be repeated or spread over many
rows; rows without a basket key belong to no basket; an empty table gives no rows; ties do not arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """Lower case, trimmed, runs of blanks reduced to one."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def block_pairs(few: DataFrame, block: int, salts: int = 32) -> DataFrame:
    """``few``: basket, i (distinct). Gives w, x, y: the number of baskets with all items of the arrays x and y, whose
    pairs between them are to be counted, or those within x where y is null."""
    from runweave.session import parallelism

    long = few.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    long = long.select("basket", F.ceil(F.col("n") / block).cast("bigint").alias("nb"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    # A long basket's rows meet its size under several salts, as they may be any part of all rows.
    salted = few.withColumn("salt", F.pmod(F.xxhash64("i", F.lit(1)), F.lit(salts)).cast("int"))
    keyed = salted.join(long, ["basket", "salt"], "left").withColumn("nb", F.coalesce("nb", F.lit(1).cast("bigint")))
    held = keyed.groupBy("basket", "nb", F.pmod(F.xxhash64("i", F.lit(2)), "nb").alias("k")).agg(F.sort_array(F.collect_list("i")).alias("x"))
    short = held.where("nb = 1 AND size(x) > 1").select("x", F.lit(None).cast(held.schema["x"].dataType).alias("y"))
    met = (
        held.where("nb > 1").select("basket", "k", "x", F.explode(F.expr("sequence(0L, nb - 1)")).alias("q"))
        .groupBy("basket", F.least("k", "q").alias("p"), F.greatest("k", "q").alias("r"))
        .agg(F.min_by("x", "k").alias("x"), F.max_by("x", "k").alias("y"), F.count(F.lit(1)).alias("m"))
        .where("p = r OR m = 2").select("x", F.when(F.col("p") < F.col("r"), F.col("y")).alias("y"))
    )
    return short.unionByName(met).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")).repartition(parallelism(few.sparkSession), "x", "y")


def pairs(rows: DataFrame, *, min_count: int = 1, block: int = 256) -> DataFrame:
    """``rows``: basket, item. Gives item_a < item_b, n_a, n_b, n_ab (numbers of baskets)."""
    from runweave.session import cut

    held = rows.where("basket IS NOT NULL AND item IS NOT NULL AND item <> ''").select("basket", "item").distinct()
    held = cut(held)
    known = cut(
        held.groupBy("item").agg(F.count(F.lit(1)).alias("n_i")).where(F.col("n_i") >= min_count)
        .select("item", "n_i", F.xxhash64("item").alias("h"))
    )
    # Ids of 8 bytes instead of texts. Equal hashes of different items would be seen here.
    twice = known.groupBy("h").count().where("count > 1").limit(1).count()
    key = "item" if twice else "h"
    few = held.join(known.select("item", "h"), "item").select("basket", F.col(key).alias("i"))
    each = block_pairs(few, block).select("w", "x", "y", F.posexplode("x").alias("k", "a"))
    both = each.select("w", "a", F.explode(F.expr("CASE WHEN y IS NULL THEN slice(x, k + 2, size(x)) ELSE y END")).alias("b"))
    both = both.select("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    counted = both.groupBy("a", "b").agg(F.sum("w").alias("n_ab")).where(F.col("n_ab") >= min_count)
    named = known.select(F.col(key).alias("i"), F.col("item"), F.col("n_i"))
    left = named.select(F.col("i").alias("a"), F.col("item").alias("item_1"), F.col("n_i").alias("n_1"))
    right = named.select(F.col("i").alias("b"), F.col("item").alias("item_2"), F.col("n_i").alias("n_2"))
    out = counted.join(left, "a").join(right, "b")
    first = F.col("item_1") < F.col("item_2")
    return out.select(
        F.when(first, F.col("item_1")).otherwise(F.col("item_2")).alias("item_a"),
        F.when(first, F.col("item_2")).otherwise(F.col("item_1")).alias("item_b"),
        F.when(first, F.col("n_1")).otherwise(F.col("n_2")).alias("n_a"),
        F.when(first, F.col("n_2")).otherwise(F.col("n_1")).alias("n_b"),
        "n_ab",
    )


def scored(found: DataFrame, n: Column) -> DataFrame:
    """Adds lift = P(ab) / (P(a) P(b)) and conviction of a -> b = P(a) P(not b) / P(a, not b);
    conviction is null where a never occurs without b."""
    lift = F.col("n_ab") * n / (F.col("n_a") * F.col("n_b"))
    conviction = F.when(F.col("n_a") > F.col("n_ab"), F.col("n_a") * (n - F.col("n_b")) / (n * (F.col("n_a") - F.col("n_ab"))))
    return found.withColumn("lift", lift.cast("double")).withColumn("conviction", conviction.cast("double"))
