"""First success by priority, and choices of one row among several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.functions.text import empty_to_null, resized, search_address, search_name

# The sources of a cover, in order.
SOURCES = ("cdn resized", "cdn original", "song exact", "song cleaned", "album", "recording")


def candidates(artist: Column, title: Column, cover: Column, size: int = 600) -> Column:
    """What to try for a cover, in order: priority, source, address. The cleaned search is only made if cleaning
    changed a name; the two first need an address."""
    clean_artist, clean_title = search_name(artist), search_name(title)
    url = empty_to_null(cover)
    rows = [
        (url.isNotNull(), resized(url, size)), (url.isNotNull(), url), (F.lit(True), search_address("song", artist, title)),
        ((clean_artist != artist) | (clean_title != title), search_address("song", clean_artist, clean_title)),
        (F.lit(True), search_address("album", artist, title)), (F.lit(True), search_address("recording", artist, title)),
    ]
    made = [F.when(on, F.struct(F.lit(k + 1).alias("priority"), F.lit(SOURCES[k]).alias("source"), u.alias("address"))) for k, (on, u) in enumerate(rows)]
    return F.array_compact(F.array(*made))


def first_success(df: DataFrame, keys: list[str], priority: str, value: str, columns: list[str]) -> DataFrame:
    """The row of least priority whose value is neither null nor empty; keys without any get nulls."""
    ok = F.col(value).isNotNull() & (F.length(value) > 0)
    best = F.min(F.when(ok, F.struct(F.col(priority), *[F.col(c) for c in columns])))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in columns])


def matching_file(lists: DataFrame, files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """The audio file of each list: lists (list_stem), files (path, stem, suffix). The exact stem goes before the stem without
    its mark; among extensions the order given decides, then the path."""
    wanted = lists.select("list_stem", F.explode(F.array(F.struct(F.lit(1).alias("p"), F.col("list_stem").alias("s")), F.struct(F.lit(2).alias("p"), F.regexp_replace("list_stem", "_tracklist$", "").alias("s")))).alias("w")).select("list_stem", "w.p", "w.s").dropDuplicates(["list_stem", "s"])
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.col("suffix"))
    found = wanted.join(files.where(rank > 0), F.col("s") == F.col("stem"), "left")
    best = F.min(F.when(F.col("path").isNotNull(), F.struct("p", rank.alias("r"), "path")))
    return found.groupBy("list_stem").agg(best.alias("b")).select("list_stem", F.col("b.path").alias("path"))
