"""Collapsing ordered samples to runs with gaps.

Within each set, a key that occurs once in the whole set is no evidence and counts as a gap. Of the
rest a row is kept where the key differs from the last key seen (gaps do not end a run), and
for each run the first gap row after its start. Gaps before the first key are dropped.

The set may be any part of the data. The rows are moved once, by set and chunk of neighbouring positions; in that layout repeats of a position are
removed, and each chunk is reduced to the rows that can begin a run or be the first gap of one. Only these, far fewer than the rows, go on: what crosses
the chunks' borders (the last key and the number of run starts so far) is a table with a row per chunk. Counting keys is an aggregation with a map-side
combine over the same layout; the positions of one-off keys come back as a list per chunk, which holds ``width`` of them at most.

Edge cases: rows without a set or position are left out; a null key is a gap; several rows at one position are
not expected unless ``order`` says which one counts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.session import cut


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by ``order``, as keys and ``columns``; combined on the map side."""
    best = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in columns if c not in order]))
    return df.groupBy(*keys).agg(best.alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])


def in_chunks(df: DataFrame, group: str, position: str, order: list[str] | None = None, width: int = 4096) -> DataFrame:
    """``df`` laid out by (group, chunk of positions), with _b, the chunk; of several rows at a position the last by ``order``."""
    rows = df.where(F.col(group).isNotNull() & F.col(position).isNotNull()).withColumn("_b", F.floor(F.col(position) / width)).repartition(group, "_b")
    if not order:
        return rows
    w = Window.partitionBy(group, "_b", position).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def collapse(
    df: DataFrame, group: str, position: str, key: Column, carry: list[str], *, width: int = 4096, singletons: bool = True, order: list[str] | None = None, then: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """group, position, ``carry``, matched (whether the row begins a run; else it is a gap row) and run (from 1).

    order: of several rows at a position the last by these counts. then: what is done to the rows afterwards, before ``key`` and ``carry`` are taken from them."""
    laid = in_chunks(df, group, position, order, width)
    laid = then(laid) if then else laid
    src = laid.select(
        F.col(group).alias("g"), F.col("_b").alias("b"), F.col(position).cast("bigint").alias("i"), key.alias("k0"), F.struct(*[F.col(c) for c in carry]).alias("c") if carry else F.lit(None).cast("string").alias("c")
    )
    if singletons:
        counted = src.where("k0 IS NOT NULL").groupBy("g", "k0").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i")).where("n = 1")
        once = counted.groupBy("g", F.floor(F.col("i") / width).alias("b")).agg(F.collect_list("i").alias("once"))
        src = src.join(once.hint("merge"), ["g", "b"], "left").withColumn("k", F.when(F.col("once").isNull() | ~F.array_contains("once", F.col("i")), F.col("k0"))).drop("once")
    else:
        src = src.withColumn("k", F.col("k0"))
    chunk = Window.partitionBy("g", "b").orderBy("i")
    before = chunk.rowsBetween(Window.unboundedPreceding, -1)
    # A chunk's rows that may count: where the key changes, and the first gap behind such a row or behind the chunk's begin.
    local = src.withColumn("pk", F.last("k", ignorenulls=True).over(before))
    new = F.col("k").isNotNull() & ~F.col("k").eqNullSafe(F.col("pk"))
    local = local.withColumn("st", new).withColumn("last_gap", F.max(F.when(F.col("k").isNull(), F.col("i"))).over(before))
    local = local.withColumn("last_st", F.max(F.when(F.col("st"), F.col("i"))).over(before))
    gap = F.col("k").isNull() & (F.col("last_gap").isNull() | (F.col("last_gap") < F.col("last_st")))
    few = cut(local.where(F.col("st") | gap).select("g", "b", "i", "c", "k", "st"))
    # The first key of a chunk may go on with the run before it; all others begin one.
    sums = few.where("st").groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"), F.min_by("k", "i").alias("first_k"), F.min("i").alias("first_i"), F.max_by("k", "i").alias("last_k"))
    chunks = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    border = sums.withColumn("carry_k", F.last("last_k").over(chunks))
    border = border.withColumn("goes_on", F.col("first_k").eqNullSafe(F.col("carry_k"))).withColumn("own", F.col("n") - F.col("goes_on").cast("bigint"))
    border = border.select("g", "b", "goes_on", "first_i", F.sum("own").over(chunks.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "own")
    return _numbered_runs(few, border, group, position, carry)


def _numbered_runs(few: DataFrame, border: DataFrame, group: str, position: str, carry: list[str]) -> DataFrame:
    """Runs of the rows that may count, from the number of starts before each chunk. Chunks of gaps alone have no row in ``border``; their first gap belongs to the last chunk before that has one."""
    chunks = few.select("g", "b").distinct().join(border, ["g", "b"], "left")
    last = F.coalesce(F.last("upto", ignorenulls=True).over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    base = chunks.select("g", "b", "goes_on", "first_i", (last - F.coalesce("own", F.lit(0))).alias("base"))
    start = F.col("st") & ~(F.col("goes_on") & (F.col("i") == F.col("first_i")))
    inside = Window.partitionBy("g", "b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = few.join(base, ["g", "b"]).withColumn("begins", F.coalesce(start, F.lit(False))).withColumn("run", F.col("base") + F.sum(F.col("begins").cast("bigint")).over(inside))
    # A run has one start and any number of gap rows; the least position of either kind is kept.
    kinds = rows.where("begins OR (k IS NULL AND run > 0)").groupBy("g", "run", F.col("begins").alias("matched"))
    out = kinds.agg(F.min(F.struct("i", "c")).alias("m")).select("g", "m.i", "m.c", "matched", "run")
    return out.select(F.col("g").alias(group), F.col("i").alias(position), *[F.col(f"c.{c}").alias(c) for c in carry], "matched", "run")


def numbered(df: DataFrame, group: str, order: list[str], *, amount: str | None = None, width: int = 4096) -> DataFrame:
    """``df`` with rn (from 1 by ``order`` within the group), n (rows of the group) and, where ``amount`` is named, before
    (the sum of it over earlier rows).

    The first column of ``order`` is a whole number; rows are numbered within chunks of ``width`` of it, and the counts of
    earlier chunks are added, so that no group is one task's work. Rows without a group or position are left out."""
    rows = df.where(F.col(group).isNotNull() & F.col(order[0]).isNotNull()).withColumn("_b", F.floor(F.col(order[0]) / width))
    sums = rows.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"), (F.sum(amount) if amount else F.lit(0)).alias("_s"))
    chunks = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c: F.coalesce(F.sum(c).over(chunks), F.lit(0))
    border = sums.select(group, "_b", prior("_n").alias("_base"), F.sum("_n").over(Window.partitionBy(group)).alias("n"), prior("_s").alias("_sbase"))
    w = Window.partitionBy(group, "_b").orderBy(*order)
    local = rows.withColumn("_rn", F.row_number().over(w))
    if amount:
        local = local.withColumn("_sum", F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = local.join(border, [group, "_b"]).withColumn("rn", F.col("_base") + F.col("_rn"))
    if amount:
        out = out.withColumn("before", F.col("_sbase") + F.col("_sum"))
    return out.select(*df.columns, "rn", "n", *(["before"] if amount else []))
