"""Files as tables: audio files, documents, stored JSON; and tables as files."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions.rows import is_audio
from runweave.functions.text import stem, suffix
from runweave.operators import corrections, documents
from runweave.session import cut


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at the path, on any file system that the cluster knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def audio_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, stem, suffix, size of the audio files at the paths, each once: files as given, folders without their subfolders. A path where
    nothing is gives a warning and no rows. Contents are never read, as the column is not selected."""
    there = [p for p in dict.fromkeys(paths) if exists(spark, p)]
    for p in dict.fromkeys(paths):
        if p not in there:
            warnings.warn(f"no such file or folder: {p}", stacklevel=2)
    if not there:
        return spark.createDataFrame([], "path string, stem string, suffix string, size bigint")
    found = spark.read.format("binaryFile").load(there)
    named = found.select("path", stem(F.col("path")).alias("stem"), suffix(F.col("path")).alias("suffix"), F.col("length").alias("size"))
    return named.where(is_audio(F.col("suffix"))).dropDuplicates(["path"]).orderBy("path")


def whole_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, value: one row per file."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


HIT = "struct<title:string,artist:string,shazam_url:string,album:string,coverart_url:string>"


def progress(texts: DataFrame, key: Column, column: str = "value", *, step: int | None = None, strict: bool = True) -> DataFrame:
    """set_id, sample_idx, ts, hit of stored progress logs ``[[seconds, match or null], ...]``; no text means none finished.

    A text that is no log is an error, as it would mean that everything is recognised, and paid for, again; with strict=False it
    gives no rows. step: seconds between samples, from which the index follows; else it is the place in the log."""
    log = F.try_parse_json(F.col(column))
    rows = F.variant_get(log, "$", "array<variant>") if strict else F.try_variant_get(log, "$", "array<variant>")
    if strict:
        broken = F.col(column).isNotNull() & log.isNull()
        rows = F.when(broken, F.raise_error(F.concat(F.lit("corrupt progress log of "), F.coalesce(key.cast("string"), F.lit("?")))).cast("array<variant>")).otherwise(rows)
    out = texts.select(key.alias("set_id"), F.posexplode(rows).alias("place", "v")).withColumn("ts", F.try_variant_get("v", "$[0]", "int"))
    index = F.col("place").cast("bigint") if step is None else F.floor(F.col("ts") / step).cast("bigint")
    return out.select("set_id", index.alias("sample_idx"), "ts", F.try_variant_get("v", "$[1]", HIT).alias("hit"))


def write_progress(samples: DataFrame, folder: str, *, width: int = 4096) -> None:
    """samples (set_id, sample_idx, ts, hit) as progress logs, a text per set and ``width`` positions, so that a set of any length is no single
    row; a part that is written again replaces its text, and no other."""
    entry = F.to_json(F.struct(F.col("hit").alias("h")), {"ignoreNullFields": "false"})
    # The match alone, out of its wrapping {"h":...}.
    pair = F.concat(F.lit("["), F.col("ts").cast("string"), F.lit(","), entry.substr(F.lit(6), F.length(entry) - 6), F.lit("]"))
    rows = samples.where("set_id IS NOT NULL AND ts IS NOT NULL").select(F.col("set_id").alias("document"), F.floor(F.col("sample_idx") / width).alias("part"), "sample_idx", pair.alias("pair"))
    texts = rows.groupBy("document", "part").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "pair"))).alias("a"))
    out = texts.select("document", "part", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["pair"]), ","), F.lit("]")).alias("value"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document", "part").text(folder)


def read_progress(spark: SparkSession, folder: str, step: int) -> DataFrame:
    """What ``write_progress`` wrote; a folder that is not there means none finished."""
    if not exists(spark, folder):
        return spark.createDataFrame([], f"set_id string, sample_idx bigint, ts int, hit {HIT}")
    texts = spark.read.schema("value string, document string, part bigint").text(folder, wholetext=True)
    return progress(texts, F.col("document"), step=step)


def save_lists(lists: DataFrame, edits: DataFrame, log: DataFrame, folder: str, now: Column) -> None:
    """One save of an editor: lists (set_id, source_file, generated_on, tracks) as markdown and as JSON, a text per set that replaces the one before,
    and the corrections that ``edits`` teach, compacted with the log into a table of its own."""
    write_documents(lists.select("set_id", documents.markdown(F.col("source_file"), F.col("generated_on"), F.col("tracks"), now).alias("t")), f"{folder}/markdown", "set_id", "t")
    write_documents(lists.select("set_id", documents.json_text(F.col("tracks")).alias("t")), f"{folder}/json", "set_id", "t")
    new = corrections.learned(edits, now)
    cut(corrections.dimension(log.select(*new.columns).unionByName(new))).write.mode("overwrite").parquet(f"{folder}/corrections")


def write_documents(df: DataFrame, folder: str, key: str, text: str) -> None:
    """One folder per key with the text as its only file; a key that is written again replaces its folder, and no other."""
    out = df.select(F.col(key).alias("document"), F.col(text).alias("value")).repartition(F.col("document"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document").text(folder)


def number(text: Column) -> Column:
    """The number that a probe printed; null if it is none."""
    return F.trim(F.regexp_replace(text, r"[\r\n]+$", "")).try_cast("double")


def first_line(text: Column) -> Column:
    return F.try_element_at(F.split(text, "\n"), F.lit(1))
