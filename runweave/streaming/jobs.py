"""Streaming forms: windows of the clock with late rows, incremental loading, collapse of touched sets, running collapse."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.operators.runs import collapse, latest
from runweave.session import cut
from runweave.sources.files import exists


def stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def tumbling(rows: DataFrame, time: str, group: str, *, length: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts per group and window. In append mode a window is given once, when the watermark (the latest time seen less ``late``) has passed its
    end, its state is dropped, and rows that come for it afterwards are left out; in complete mode nothing is ever dropped."""
    timed = rows.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(group, F.window("_at", length).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(group, F.col("w.start").alias("window_start"), "n")


def run_available(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that has arrived since the last call, once; what was done before is in ``checkpoint``."""
    query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def append_to(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch under its number, so that a batch done twice is there once."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}")


def collapse_touched(all_rows: Callable[[], DataFrame], folder: str, key: Callable[[], object], carry: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that collapses again, from all rows, the sets that a batch touched, and replaces their results. A late sample
    changes its set only; sets are partitions of the result by hash, so that a batch rewrites few files."""

    def sink(batch: DataFrame, _: int) -> None:
        touched = batch.select("set_id").distinct()
        rows = latest(all_rows().join(touched, "set_id", "left_semi"), ["set_id", "sample_idx"], ["received_at"], ["received_at", *carry])
        out = collapse(rows, "set_id", "sample_idx", key(), carry)
        part = F.pmod(F.xxhash64("set_id"), F.lit(64)).alias("part")
        if exists(batch.sparkSession, folder):
            before = batch.sparkSession.read.parquet(folder)
            keep = before.join(touched.withColumn("part", F.pmod(F.xxhash64("set_id"), F.lit(64))).select("part").distinct(), "part", "left_semi").join(touched, "set_id", "left_anti")
            out = out.select(*out.columns, part).unionByName(keep.select(*out.columns, "part"))
            out = cut(out)
        else:  # the first batch finds no results yet
            out = out.select(*out.columns, part)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)

    return sink


PARTS = 64


def collapse_arrived(store: str, folder: str, key: Callable[[], object], carry: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps what has arrived in ``store``, laid out by a hash of the set, and collapses the touched sets again from
    the parts of it that hold them. A batch that is done twice replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("set_id"), F.lit(PARTS)).alias("part")
        batch.select("*", part).write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={number}")
        parts = [r[0] for r in batch.select(part).distinct().collect()]
        if parts:
            collapse_touched(lambda: spark.read.parquet(store).where(F.col("part").isin(parts)), folder, key, carry)(batch, number)

    return sink


def running_collapse(rows: DataFrame, group: str, position: str, key: str, *, closing: str | None = None) -> DataFrame:
    """Run starts as they arrive: group, position, key and kind, with a state per group.

    A 'start' is provisional, as whether a key occurs only once in a set is known at the set's end. The end is a row whose column ``closing`` is true;
    then every start of a key that occurred once is given again as 'withdrawn', and the state
    is dropped. Without such a column, sets never end and nothing is withdrawn. The state holds the last key and each key's count and first position.

    Rows of a batch are ordered by position, and late ones are compared to the state at hand. A batch's rows of one set are in one task at once: the
    stream's files (or bytes) per trigger bound them."""
    ends = closing or "_end"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, keys, counts, places = state.get if state.exists else (None, [], [], [])
        seen = {x: [n, i] for x, n, i in zip(keys, counts, places)}
        out: list[tuple] = []
        f = pd.concat(list(frames)).sort_values(position)
        held = f[f[key].notna()]
        if len(held):
            prior = held[key].shift()
            prior.iloc[0] = last
            last = held[key].iloc[-1]
            begins = held[held[key] != prior]
            out += [(i, x, "start") for i, x in zip(begins[position], begins[key])]
            for x, n, i in held.groupby(key, sort=False)[position].agg(["size", "min"]).itertuples():
                seen.setdefault(x, [0, int(i)])[0] += int(n)
        if f[ends].fillna(False).astype(bool).any():
            out += [(i, x, "withdrawn") for x, (n, i) in seen.items() if n == 1]
            state.remove()
        else:
            state.update((last, list(seen), [v[0] for v in seen.values()], [v[1] for v in seen.values()]))
        if out:
            yield pd.DataFrame({group: k[0], position: [x[0] for x in out], key: [x[1] for x in out], "kind": [x[2] for x in out]})

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = f"`{group}` {types[group]}, `{position}` {types[position]}, `{key}` {types[key]}, kind string"
    source = rows.select(group, position, key, F.col(closing).cast("boolean").alias(ends) if closing else F.lit(False).alias(ends))
    held = "last string, keys array<string>, counts array<bigint>, places array<bigint>"
    return source.groupBy(group).applyInPandasWithState(step, made, held, "append", "NoTimeout")
