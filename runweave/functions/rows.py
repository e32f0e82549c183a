"""Predicates and labels of tracks, and projections of what services answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.functions.text import UNKNOWN_TRACK, empty_to_null

# The extensions of audio files.
AUDIO = (".mp3", ".wav", ".flac", ".m4a", ".ogg", ".aac", ".wma", ".aiff")


def is_unidentified(artist: Column, title: Column) -> Column:
    return (F.coalesce(artist, F.lit("")) == "") & (F.coalesce(title, F.lit("")) == "")


def was_corrected(artist: Column, title: Column, original_artist: Column, original_title: Column) -> Column:
    return (original_artist.isNotNull() | original_title.isNotNull()) & (~artist.eqNullSafe(original_artist) | ~title.eqNullSafe(original_title))


def status(rejected: Column, corrected: Column, unidentified: Column) -> Column:
    return F.when(rejected, "REJECTED").when(corrected, "EDITED").when(unidentified, "UNKNOWN").otherwise("")


def track_label(artist: Column, title: Column) -> Column:
    return F.when(is_unidentified(artist, title), F.lit(UNKNOWN_TRACK)).otherwise(F.concat(F.coalesce(artist, F.lit("")), F.lit(" - "), F.coalesce(title, F.lit(""))))


def is_audio(suffix: Column) -> Column:
    return suffix.isin(*AUDIO)


# What a failure of rate says, anywhere in its message.
RATE_WORDS = ("429", "too many", "rate")


def may_retry(message: Column) -> Column:
    """Whether a failure is one of rate."""
    return F.lower(message).rlike("|".join(RATE_WORDS))


def supported_formats() -> Column:
    """The extensions of audio files as a message lists them, in order."""
    return F.array_join(F.array_sort(F.array(*map(F.lit, AUDIO))), ", ")


def card_layout(size: Column) -> Column:
    """Where things stand on a square card of ``size`` pixels: the bar over its lower part, the two lines of text and their heights."""
    part = lambda k: F.floor(size / k).cast("int")
    bar, pad, title, artist = F.floor(size * F.lit(0.72)).cast("int"), part(30), F.greatest(part(18), F.lit(16)), F.greatest(part(22), F.lit(13))
    return F.struct(
        bar.alias("bar_top"), pad.alias("padding"), title.alias("title_height"), artist.alias("artist_height"),
        (bar + pad).alias("title_y"), (bar + pad + title + F.floor(pad / 2).cast("int")).alias("artist_y"), (size.cast("int") - 2 * pad).alias("text_width"),
    )


_ANSWER = (
    "struct<track:struct<title:string,subtitle:string,url:string,images:struct<coverart:string,coverarthq:string>,"
    "sections:array<struct<metadata:array<struct<text:string>>>>>>"
)


def recognised(df: DataFrame, answer: Column, name: str) -> DataFrame:
    """``df`` with a recogniser's JSON answer as a match, null where it holds no track. Null names get the defaults;
    a track without metadata has a null album. The answer is parsed once: the generator keeps the parsed
    value from being put into every expression that uses it."""
    parsed = df.select("*", F.explode(F.array(F.from_json(answer, _ANSWER)["track"])).alias("_track"))
    track = F.col("_track")
    first = lambda a: F.try_element_at(a, F.lit(1))
    match = F.struct(
        F.coalesce(track["title"], F.lit("Unknown Title")).alias("title"),
        F.coalesce(track["subtitle"], F.lit("Unknown Artist")).alias("artist"),
        track["url"].alias("shazam_url"),
        first(first(track["sections"])["metadata"])["text"].alias("album"),
        F.coalesce(empty_to_null(track["images"]["coverarthq"]), empty_to_null(track["images"]["coverart"])).alias("coverart_url"),
    )
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns], F.when(track.isNotNull(), match).alias(name))


def song_cover(answer: Column) -> Column:
    return F.when(F.get_json_object(answer, "$.resultCount").try_cast("int") > 0, empty_to_null(F.get_json_object(answer, "$.results[0].artworkUrl100")))


def album_cover(answer: Column) -> Column:
    return F.coalesce(empty_to_null(F.get_json_object(answer, "$.data[0].album.cover_xl")), empty_to_null(F.get_json_object(answer, "$.data[0].album.cover_big")))


def release_id(answer: Column) -> Column:
    return empty_to_null(F.get_json_object(answer, "$.recordings[0].releases[0].id"))


def loudness(report: Column) -> Column:
    """The figures of the first braces in a loudness report; null as a whole if one is no number; a missing one is 0."""
    block = F.from_json(empty_to_null(F.regexp_extract(report, r"\{[^}]+\}", 0)), "map<string,string>")
    figure = lambda k: F.when(F.map_contains_key(block, F.lit(k)), block[k].try_cast("double")).otherwise(F.lit(0.0))
    i, p, r = figure("input_i"), figure("input_tp"), figure("input_lra")
    return F.when(block.isNotNull() & i.isNotNull() & p.isNotNull() & r.isNotNull(), F.struct(i.alias("loudness_i"), p.alias("true_peak"), r.alias("loudness_range")))


def levels(report: Column) -> Column:
    """The level series of a report; what is no plain number (infinite, none) is left out."""
    return F.transform(F.regexp_extract_all(report, F.lit(r"RMS_level=(-?[\d.]+)"), F.lit(1)), lambda x: x.try_cast("double"))
