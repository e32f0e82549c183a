"""Most frequent values of columns with very many distinct values: exact prefix refinement.

A value is hashed to 64 bits. The number of rows below a hash prefix is an upper bound for
the count of every value below it, so a prefix whose count is under the bound that a result
row has to reach can be left out whole. Prefixes are counted by SQL, the survivors are
lengthened, and the last pass counts the full values below the surviving prefixes.

Memory: a pass never has more than ``fields * 2**bits[0]`` groups at first; afterwards at most
``rows / bound`` prefixes survive per field and each has ``2**step`` children. Every
aggregation is combined on the map side, so a value that makes up a third of all rows is
one row per task in the shuffle.

Edge cases: nulls and empty strings are no values (``keep_empty=True`` counts empty ones);
values are compared exactly as they stand; ties at rank ``k`` are cut by the value's code
point order; an empty table gives no rows; other columns are never read; a field named like
a work column is fine as input columns are addressed by the caller's expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.session import cut

BITS = (14, 28)
#: Surviving prefixes up to this many are joined by broadcast (16 bytes each); more by shuffle.
BROADCAST_PREFIXES = 100_000


def _long(df: DataFrame, fields: dict[str, Column], keep_empty: bool) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("item")) for n, c in fields.items()])
    long = df.select(F.explode(pairs).alias("p")).select("p.field", "p.item")
    long = long.where(F.col("item").isNotNull() if keep_empty else F.length("item") > 0)
    return long.withColumn("h", F.xxhash64("item"))


def _prefix(bits: int) -> Column:
    return F.col("h") if bits == 64 else F.shiftrightunsigned("h", 64 - bits)


def _below(long: DataFrame, alive: DataFrame, bits: int) -> DataFrame:
    """The rows whose prefix of ``bits`` bits is among ``alive``."""
    keys = alive.select("field", F.col("prefix").alias("_p"))
    if alive.count() <= BROADCAST_PREFIXES:
        keys = F.broadcast(keys)
    return long.withColumn("_p", _prefix(bits)).join(keys, ["field", "_p"], "left_semi").drop("_p")


def _refine(long: DataFrame, counts: DataFrame, bound: DataFrame, bits: tuple[int, ...]) -> DataFrame:
    """Exact (field, item, n) of all values with ``n >= bound`` of their field."""
    level = bits[0]
    for longer in (*bits[1:], 0):
        alive = cut(counts.join(F.broadcast(bound), "field").where("n >= bound").select("field", "prefix"))
        rows = _below(long, alive, level)
        if not longer or longer == 64:
            break
        counts = rows.groupBy("field", _prefix(longer).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        level = longer
    return (
        rows.groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(bound), "field").where("n >= bound").select("field", "item", "n")
    )


def by_share(df: DataFrame, fields: dict[str, Column], num: int, den: int, *, bits: tuple[int, ...] = BITS, keep_empty: bool = False) -> DataFrame:
    """Values that make up at least ``num/den`` of the values of their field: field, item, n, total.

    The bound is known after the first count, as the prefix counts of a field add up to its total."""
    long = _long(df, fields, keep_empty)
    first = cut(long.groupBy("field", _prefix(bits[0]).alias("prefix")).agg(F.count(F.lit(1)).alias("n")))
    total = first.groupBy("field").agg(F.sum("n").alias("total"))
    bound = cut(total.select("field", "total", F.expr(f"greatest(1L, (total * {num}L + {den - 1}L) div {den}L)").alias("bound")))
    got = _refine(long, first, bound.select("field", "bound"), bits)
    return got.join(F.broadcast(bound.select("field", "total")), "field")


def top_k(df: DataFrame, fields: dict[str, Column], k: int, *, bits: tuple[int, ...] = BITS, keep_empty: bool = False) -> DataFrame:
    """The ``k`` most frequent values of each field: field, item, n, rank.

    The lower bound of the k-th count: the values below the ``k`` fullest prefixes are counted
    exactly; the k-th of these counts is reached by at least k values."""
    from pyspark.sql import Window

    long = _long(df, fields, keep_empty)
    first = cut(long.groupBy("field", _prefix(bits[0]).alias("prefix")).agg(F.count(F.lit(1)).alias("n")))
    by_n = Window.partitionBy("field").orderBy(F.desc("n"), "prefix")
    fullest = first.withColumn("r", F.row_number().over(by_n)).where(F.col("r") <= k).select("field", "prefix")
    seen = _below(long, fullest, bits[0]).groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))
    by_value = Window.partitionBy("field").orderBy(F.desc("n"), "item")
    kth = seen.withColumn("r", F.row_number().over(by_value)).where(F.col("r") <= k)
    bound = cut(kth.groupBy("field").agg(F.expr(f"CASE WHEN max(r) = {k} THEN min(n) ELSE 1L END").alias("bound")))
    got = _refine(long, first, bound, bits)
    return got.withColumn("rank", F.row_number().over(by_value).cast("bigint")).where(F.col("rank") <= k)
