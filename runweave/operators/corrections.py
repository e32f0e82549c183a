"""Learned corrections: a keyed log of which the last entry holds, applied by an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.functions.rows import is_unidentified, was_corrected
from runweave.functions.text import correction_key
from runweave.operators.runs import latest

STORE = "corrections map<string,struct<artist:string,title:string,original_artist:string,original_title:string,corrected_at:string>>"
COLUMNS = ["artist", "title", "original_artist", "original_title", "corrected_at"]


def dimension(log: DataFrame) -> DataFrame:
    """The log compacted to one row per key: last by time, then by value."""
    return latest(log.where("cor_key IS NOT NULL"), ["cor_key"], ["corrected_at", "artist", "title", "original_artist", "original_title"], COLUMNS)


def apply(rows: DataFrame, corrections: DataFrame, *, hops: int = 1, skip_unidentified: bool = True, only: Column | None = None) -> DataFrame:
    """``rows`` (artist, title, original_artist, original_title, ...) with names replaced where their key is in ``corrections``,
    the names before in original_*, and ``corrected``. One hop per call of the join; a chain a -> b -> c takes two.

    ``only`` says which rows take part at all; those that do not, and unidentified ones, get a key of their own content that
    no correction has, so that they are spread over the join's tasks.

    The dimension is broadcast by the optimizer when it is known to be small and joined by shuffle otherwise."""
    names = corrections.select(F.col("cor_key").alias("_key"), F.col("artist").alias("_artist"), F.col("title").alias("_title"))
    out = rows.withColumn("corrected", F.lit(False))
    for _ in range(hops):
        key, takes_part = correction_key(F.col("artist"), F.col("title")), only
        if skip_unidentified:
            named = ~is_unidentified(F.col("artist"), F.col("title"))
            takes_part = named if only is None else only & named
        if takes_part is not None:
            key = F.when(takes_part, key).otherwise(F.concat(F.lit("\0"), F.xxhash64(*out.columns).cast("string")))
        hit = F.col("_artist").isNotNull() | F.col("_title").isNotNull()
        joined = out.withColumn("_key", key).join(names, "_key", "left")
        out = joined.select(
            *[
                {
                    "artist": F.when(hit, F.col("_artist")).otherwise(F.col("artist")),
                    "title": F.when(hit, F.col("_title")).otherwise(F.col("title")),
                    "original_artist": F.when(hit, F.col("artist")).otherwise(F.col("original_artist")),
                    "original_title": F.when(hit, F.col("title")).otherwise(F.col("original_title")),
                    "corrected": F.col("corrected") | hit,
                }.get(c, F.col(c)).alias(c)
                for c in out.columns
            ]
        )
    return out


def learned(edits: DataFrame, at: Column) -> DataFrame:
    """Log rows of the edits that changed a name, keyed by the name before."""
    changed = was_corrected(*[F.col(c) for c in ("artist", "title", "original_artist", "original_title")])
    return edits.where(changed).select(
        correction_key(F.coalesce("original_artist", F.lit("")), F.coalesce("original_title", F.lit(""))).alias("cor_key"),
        "artist", "title", "original_artist", "original_title", at.alias("corrected_at"),
    )


def from_store(texts: DataFrame, column: str = "value") -> DataFrame:
    """The log rows of stored JSON documents; a document that is no JSON holds none."""
    store = F.from_json(F.col(column), STORE)
    return texts.select(F.explode(store["corrections"]).alias("cor_key", "c")).select("cor_key", "c.*")


def to_store(corrections: DataFrame) -> DataFrame:
    """One JSON document of a compacted dimension; for stores that fit into one value."""
    entry = F.struct("cor_key", F.struct(*COLUMNS))
    return corrections.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("corrections")).select(F.to_json(F.struct("corrections"), {"ignoreNullFields": "false"}).alias("value"))
