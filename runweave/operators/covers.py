"""Covers of recordings: each source is searched, its answer read, the image it names fetched, until one is there.

A round per source asks only for the rows that are still without an image, so nothing behind the first success is asked. A
search's answer is JSON and never taken for an image: column functions project it to an address, which is fetched in a second request. The
round's answers are settled before they are used, as every use would ask again.

Edge cases: null names count as empty; a row without any image keeps nulls; a request that fails or gives nothing falls
through to the next source; an empty table asks nothing; repeated rows are asked for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.functions import rows, text
from runweave.session import cut
from runweave.sources.providers import Provider, ask

# Where the front of a release is kept.
FRONT = "https://coverartarchive.org/release/{}/front-500"


def steps(artist: Column, title: Column, cover: Column, size: int) -> list[tuple[str, Column, Column, Callable[[Column], Column] | None]]:
    """(source, whether it is tried, request, how its answer names an image; None where the request is the image itself), in order."""
    clean_artist, clean_title = text.search_name(artist), text.search_name(title)
    url = text.empty_to_null(cover)
    song = lambda a: text.resized_literal(rows.song_cover(a), size)
    front = lambda a: F.concat(F.lit(FRONT.split("{}")[0]), rows.release_id(a), F.lit(FRONT.split("{}")[1]))
    return [
        ("cdn resized", url.isNotNull(), text.resized(url, size), None),
        ("cdn original", url.isNotNull(), url, None),
        ("song exact", F.lit(True), text.search_address("song", artist, title), song),
        ("song cleaned", (clean_artist != artist) | (clean_title != title), text.search_address("song", clean_artist, clean_title), song),
        ("album", F.lit(True), text.search_address("album", artist, title), lambda a: text.resized_between(rows.album_cover(a), size)),
        ("recording", F.lit(True), text.search_address("recording", artist, title), front),
    ]


def covers(df: DataFrame, artist: str, title: str, cover: str, make: Callable[[], Provider], *, size: int = 600, wanted: Column | None = None) -> DataFrame:
    """``df`` with source, address and data (the image) of the first source that has one. wanted: the rows that are asked for at all."""
    named = [F.coalesce(F.col(c), F.lit("")) for c in (artist, title)]
    pending = df if wanted is None else df.where(F.coalesce(wanted, F.lit(False)))
    none = lambda x: x.select(*df.columns, *[F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("address", "string"), ("data", "binary"))])
    done = [] if wanted is None else [none(df.where(~F.coalesce(wanted, F.lit(False))))]
    for source, on, request, read in steps(*named, F.col(cover), size):
        asked = pending.withColumn("_address", F.when(on, request))
        if read:
            answered = cut(ask(asked, "_address", make, answer="_answer", attempts=1)).drop("attempts", "failure")
            asked = answered.withColumn("_address", read(F.col("_answer"))).drop("_answer")
        got = cut(ask(asked, "_address", make, answer="_data", binary=True, attempts=1))
        there = F.coalesce(F.length("_data") > 0, F.lit(False))
        done.append(got.where(there).select(*df.columns, F.lit(source).alias("source"), F.col("_address").alias("address"), F.col("_data").alias("data")))
        pending = got.where(~there).select(*df.columns)
    out = none(pending)
    for d in done:
        out = out.unionByName(d)
    return out
