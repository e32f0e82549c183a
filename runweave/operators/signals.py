"""Signals: slicing, joining parts, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.operators.runs import numbered


def slices(df: DataFrame, duration_ms: str, step_ms: int = 30_000, block: int = 4096) -> DataFrame:
    """Consecutive windows of ``step_ms``, the last one short: the columns of ``df``, sample_idx, ts (whole seconds), start_ms, end_ms.

    A signal of any length is spread: a row per ``block`` windows is moved, and its windows are made where it lands."""
    d = F.col(duration_ms).cast("bigint")
    last = F.floor((d - 1) / step_ms)
    blocks = df.where(d > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / block))).alias("_block")).repartition(duration_ms, "_block")
    inside = F.sequence(F.col("_block") * block, F.least(last, (F.col("_block") + 1) * block - 1))
    out = blocks.select(*df.columns, F.explode(inside).alias("sample_idx")).withColumn("start_ms", F.col("sample_idx") * step_ms)
    return out.select(*df.columns, "sample_idx", F.floor(F.col("start_ms") / 1000).cast("bigint").alias("ts"), "start_ms", F.least(F.col("start_ms") + step_ms, d).alias("end_ms"))


def unfinished(parts: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The slices without a result yet."""
    return parts.join(done.select(*keys).distinct(), keys, "left_anti")


def joined_parts(df: DataFrame, group: str, part: str, duration: str) -> DataFrame:
    """Parts in order with the offset at which each begins in the joined signal."""
    return numbered(df, group, [part], amount=duration).withColumnRenamed("before", "offset").drop("rn", "n")


def _mean(value: Column) -> Column:
    """The mean by an exact sum to 15 decimals, so that it does not depend on the order in which rows and partial
    sums arrive; beyond 10^15 the plain one."""
    exact = (F.sum(value.cast("decimal(38,15)")).cast("double")) / F.count(value)
    return F.when(F.max(F.abs(value)) < 1e15, exact).otherwise(F.avg(value))


def profile(df: DataFrame, group: str, order: list[str], value: str, points: int = 60) -> DataFrame:
    """group, bucket (from 0), level between 0 and 1.

    Buckets hold count div points values (at least one) and are averaged; those from ``points`` on are cut off before the
    range is taken; a range under 0.01 gives 0.5 throughout. A group may be any part of the data: values are numbered in chunks
    of their order, and everything after works on at most ``points`` rows per group."""
    values = numbered(df.where(F.col(value).isNotNull()).select(group, *order, value), group, order)
    size = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    means = values.withColumn("bucket", F.floor((F.col("rn") - 1) / size).cast("bigint")).where(F.col("bucket") < points).groupBy(group, "bucket").agg(_mean(F.col(value)).alias("mean"))
    each = Window.partitionBy(group)
    low, high = F.min("mean").over(each), F.max("mean").over(each)
    return means.select(group, "bucket", F.when(high - low < 0.01, F.lit(0.5)).otherwise((F.col("mean") - low) / (high - low)).alias("level"))


def profile_array(values: Column, points: int = 60) -> Column:
    """The same for a series held in one array."""
    n = F.size(values)
    size = F.greatest(F.lit(1), F.floor(n / points)).cast("int")
    count = F.least(F.lit(points), F.ceil(n / size)).cast("int")
    piece = lambda k: F.slice(values, k * size + 1, size)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    means = F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: mean(piece(k)))).otherwise(F.array().cast("array<double>"))
    low, span = F.array_min(means), F.array_max(means) - F.array_min(means)
    return F.transform(means, lambda m: F.when(span < 0.01, F.lit(0.5)).otherwise((m - low) / span))


def tumbling(df: DataFrame, time: str, group: str, length: str = "30 seconds") -> DataFrame:
    """Counts per group and window of the clock."""
    w = F.window(F.col(time).cast("timestamp"), length)
    return df.groupBy(group, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(group, F.col("w.start").alias("window_start"), "n")
