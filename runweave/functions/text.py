"""Column functions over labels, keys and addresses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java regex flags under which classes and line ends behave as for Unicode text: (?U) classes, (?d) only \n ends a line.
UNICODE = "(?Ud)"
KEY_MARK = "|||"
UNKNOWN_TRACK = "Unknown Track"
# The glyphs of a signal profile, lowest first; the first is never used.
GLYPHS = " ▁▂▃▄▅▆▇█"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(text, rf"{UNICODE}^\s+|\s+$", "")


def empty_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def time_label(seconds: Column) -> Column:
    """``M:SS``, from an hour on ``H:MM:SS``."""
    s = seconds.cast("bigint")
    minutes, rest = F.expr("60L"), s % 60
    h, m = F.floor(s / 3600), F.floor((s % 3600) / minutes)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", h, m, rest)).when(s.isNotNull(), F.format_string("%d:%02d", F.floor(s / minutes), rest))


def seconds_of(label: Column) -> Column:
    """Seconds of ``M:SS`` or ``H:MM:SS``, without a check of ranges; null for anything else."""
    p = F.split(label, ":")
    part = lambda k: F.try_element_at(p, F.lit(k)).try_cast("bigint")
    return F.when(F.size(p) == 3, part(1) * 3600 + part(2) * 60 + part(3)).when(F.size(p) == 2, part(1) * 60 + part(2))


def duration_label(seconds: Column) -> Column:
    """``1h 2m 3s``, ``2m 5s`` or ``45s``; parts of a second are dropped."""
    h, m, s = (F.floor(x).cast("bigint") for x in (seconds / 3600, (seconds % 3600) / 60, seconds % 60))
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).when(s.isNotNull(), F.format_string("%ds", s))


def correction_key(artist: Column, title: Column) -> Column:
    return F.concat(F.lower(strip(F.coalesce(artist, F.lit("")))), F.lit(KEY_MARK), F.lower(strip(F.coalesce(title, F.lit("")))))


def recording_key(artist: Column, title: Column) -> Column:
    """Key of the run collapse: lower case, white space as it stands."""
    return F.concat(F.lower(title), F.lit("\x01"), F.lower(artist))


# What is left out of a name for a search, and the sizes in addresses of covers (the patterns of the next four functions).
def search_name(text: Column) -> Column:
    """Without bracketed parts and without featured artists. The separators U+001C to U+001F are blanks too."""
    blank = r"[\s\x1c-\x1f]"
    plain = F.regexp_replace(text, rf"{UNICODE}{blank}*[(\[][^)\]]*[)\]]", "")
    alone = F.regexp_replace(plain, rf"(?iUd){blank}+(?:feat\.?|ft\.?|featuring){blank}+.*", "")
    return F.regexp_replace(alone, rf"{UNICODE}^{blank}+|{blank}+$", "")


def resized(url: Column, size: int = 600) -> Column:
    """The pixel size in the address of a cover, before ``bb`` or ``cc``."""
    return F.regexp_replace(url, r"\d+x\d+(?=bb|cc)", f"{size}x{size}")


def resized_between(url: Column, size: int = 600) -> Column:
    """The pixel size between a slash and a hyphen."""
    return F.regexp_replace(url, r"/\d+x\d+-", f"/{size}x{size}-")


def resized_literal(url: Column, size: int = 600) -> Column:
    return F.replace(url, F.lit("100x100bb"), F.lit(f"{size}x{size}bb"))


def query_part(text: Column) -> Column:
    """A value in a query string: blanks as ``+``; ``*`` is escaped and ``~`` is not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_address(source: str, artist: Column, title: Column) -> Column:
    """The address that asks a catalogue for one recording."""
    if source == "song":
        return F.concat(F.lit("https://itunes.apple.com/search?term="), query_part(F.concat_ws(" ", artist, title)), F.lit("&entity=song&limit=1"))
    quoted = lambda name, value: F.concat(F.lit(f'{name}:"'), value, F.lit('"'))
    if source == "album":
        return F.concat(F.lit("https://api.deezer.com/search?q="), query_part(F.concat_ws(" ", quoted("artist", artist), quoted("track", title))))
    if source == "recording":
        return F.concat(F.lit("https://musicbrainz.org/ws/2/recording?query="), query_part(F.concat_ws(" AND ", quoted("artist", artist), quoted("recording", title))), F.lit("&fmt=json&limit=1"))
    raise ValueError(f"no such source: {source}")


def sparkline(values: Column) -> Column:
    """One glyph per value between 0 and 1."""
    glyph = lambda v: F.substring(F.lit(GLYPHS), F.least(F.floor(v * 8).cast("int") + 1, F.lit(8)) + 1, F.lit(1))
    return F.array_join(F.transform(values, glyph), "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def suffix(path: Column) -> Column:
    """The last extension with its dot, in lower case; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^/])\.[^./]+$", "")


def episode_label(path: Column) -> Column:
    """The file's name without its mark and last extension."""
    return F.regexp_replace(F.replace(file_name(path), F.lit("_tracklist"), F.lit("")), r"\.[^.]*$", "")


def signed_change(before: Column, after: Column) -> Column:
    """The change with one decimal, rounded from the exact binary value; a plus sign from 0 on."""
    @F.pandas_udf("string")
    def label(d: pd.Series) -> pd.Series:
        return d.map(lambda x: None if pd.isna(x) else f"{'+' if x >= 0 else ''}{x:.1f}")

    return label(after - before)


def megabytes(size: Column) -> Column:
    return size / (1024 * 1024)
