"""Tracklists as documents: markdown, JSON, chapters. A tracklist is a row with an array of tracks,
so numbering, intervals and rendering are array expressions inside the row: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.functions.rows import is_unidentified, track_label
from runweave.functions.text import UNICODE, empty_to_null, seconds_of, strip, time_label

# The lines of a markdown tracklist.
TITLE_MARK = "# Tracklist:"
DATE_LINE = r"\*Generated on (.+)\*"
TRACK_LINE = rf"{UNICODE}^\d+\.\s+(?:\*\*(.+?)\*\*\s*-\s*(.+?)|\*Unidentified\*)\s*\((\d+:\d+(?::\d+)?)\)"


def kept(tracks: Column) -> Column:
    return F.filter(tracks, lambda t: ~F.coalesce(t["rejected"], F.lit(False)))


def has_identified(tracks: Column) -> Column:
    """Whether a track that is not rejected has a name; what chapters need."""
    return F.exists(kept(tracks), lambda t: ~is_unidentified(t["artist"], t["title"]))


def markdown(source: Column, generated: Column, tracks: Column, now: Column) -> Column:
    """The document's text. Rejected tracks are left out before numbering."""

    def line(t: Column, i: Column) -> Column:
        label = time_label(t["ts"])
        named = F.concat(F.lit("**"), F.coalesce(t["artist"], F.lit("")), F.lit("** - "), F.coalesce(t["title"], F.lit("")))
        return F.concat((i + 1).cast("string"), F.lit(". "), F.when(is_unidentified(t["artist"], t["title"]), F.lit("*Unidentified*")).otherwise(named), F.lit(" ("), label, F.lit(")"))

    head = F.array(F.concat(F.lit(f"{TITLE_MARK} "), source), F.lit(""), F.concat(F.lit("*Generated on "), F.coalesce(generated, now), F.lit("*")), F.lit(""))
    return F.array_join(F.concat(head, F.transform(kept(tracks), line), F.array(F.lit(""))), "\n")


def parsed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, source_file, generated_on and the array of tracks of each markdown document; other lines are ignored."""
    body = strip(F.coalesce(F.col(text), F.lit("")))
    lines = F.split(body, "\n")
    first = lambda mark: F.try_element_at(F.filter(lines, lambda x: x.startswith(mark)), F.lit(1))
    source = F.coalesce(strip(F.replace(first(TITLE_MARK), F.lit(TITLE_MARK), F.lit(""))), F.lit(""))
    date = empty_to_null(F.regexp_extract(first("*Generated on"), DATE_LINE, 1))

    # Each line is matched once: what its groups hold comes out behind a mark that lines do not contain.
    mark = "\x02"
    matched = F.transform(lines, lambda x: F.regexp_replace(strip(F.replace(x, F.lit(mark), F.lit(""))), rf"{TRACK_LINE}[\s\S]*$", rf"{mark}$3{mark}$1{mark}$2"))

    def track(x: Column) -> Column:
        p = F.split(x, mark)
        before = lambda v: F.when(v != "", strip(v))
        return F.struct(seconds_of(p[1]).cast("int").alias("ts"), strip(p[2]).alias("artist"), strip(p[3]).alias("title"), before(p[2]).alias("original_artist"), before(p[3]).alias("original_title"))

    rows = F.transform(F.filter(matched, lambda x: x.startswith(mark)), track)
    return texts.select(F.col(key), source.alias("source_file"), date.alias("generated_on"), rows.alias("tracks"))


def json_rows(tracks: Column) -> Column:
    """The eight exported fields of each track that is not rejected."""
    return F.transform(
        kept(tracks),
        lambda t: F.struct(
            t["ts"].alias("timestamp"), time_label(t["ts"]).alias("time"), t["artist"].alias("artist"), t["title"].alias("title"), F.coalesce(t["rejected"], F.lit(False)).alias("rejected"),
            t["shazam_url"].alias("shazam_url"), t["album"].alias("album"), t["coverart_url"].alias("coverart_url"),
        ),
    )


def json_text(tracks: Column) -> Column:
    return F.to_json(json_rows(tracks), {"ignoreNullFields": "false"})


def chapters(tracks: Column, duration_ms: Column) -> Column:
    """Chapters in order of the list: pos from 0, element_id, start, end (start of the next, at last the duration; not clamped), title."""
    starts = F.transform(kept(tracks), lambda t: t["ts"].cast("bigint") * 1000)
    return F.transform(
        kept(tracks),
        lambda t, i: F.struct(
            i.cast("bigint").alias("pos"), F.format_string("chp%03d", i).alias("element_id"), (t["ts"].cast("bigint") * 1000).alias("start_ms"),
            F.coalesce(F.try_element_at(starts, i + 2), duration_ms.cast("bigint")).alias("end_ms"), track_label(t["artist"], t["title"]).alias("title"),
        ),
    )


def contents(chapter_rows: Column) -> Column:
    """The table of contents: its title and the chapters' ids in order."""
    return F.struct(F.lit("Table of Contents").alias("title"), F.transform(chapter_rows, lambda c: c["element_id"]).alias("child_element_ids"))


def sidecar(rows: DataFrame, extra: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """``rows`` with ``value`` of the last row of ``extra`` at the same keys; an empty value counts as none, after the choice."""
    from runweave.operators.runs import latest

    chosen = latest(extra, keys, order, [value]).select(*keys, empty_to_null(F.col(value)).alias("_found"))
    joined = rows.join(chosen, keys, "left")
    if value in rows.columns:
        return joined.withColumn(value, F.coalesce("_found", value)).drop("_found")
    return joined.withColumnRenamed("_found", value)
