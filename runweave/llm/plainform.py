"""Visually identical text in one form.

The text of an Arrow batch becomes one array of code points. Everything after that is table
gathers over that array: compatibility forms are replaced (with expansion offsets where one
code point becomes several), invisible code points go, look-alike letters take the script of
their word, and combining marks are composed by searching sorted (starter, mark) keys.

What stays: letters and accents that belong to a script, tabs and line ends, joined emoji
with their joiners and selectors, joiners between letters of scripts that need them.

Edge cases: null stays null and empty stays empty; bytes that are no UTF-8 become U+FFFD; a
text of any length is handled, as no step is quadratic; marks without a base stay; repeated
rows are treated alike; an empty table gives an empty table; work columns are positional, so
no column name can clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runweave.llm.arrowtext import any_in, from_codes, string_buffers, take_rows, to_codes

TOP = 0x110000
# Look-alike letters, each with the Latin letter it looks like.
CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈҺԚԜаеорсухѕіјһԁԛԝӏ", "ABEKMHOPCTYXSIJhQWaeopcyxsijhdqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικορυνχ", "ABEZHIKMNOPTYXaikopuvx"))
#: Look-alikes that Russian text does not contain: proof of nothing but imitation.
FOREIGN = "ЅІЈѕіјҺԚԜһԁԛԝӏ"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\u2012\u2212\ufe63\uff0d"
#: Ignorable code points that are no format characters: joiners of graphemes, fillers, inherent vowels, unassigned ones that are ignored, variation selectors.
FILLERS = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0100, 0xE01EF))
#: Format characters that are seen: signs before numbers.
SEEN = ((0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD))
TAGS = (0xE0020, 0xE007F)
BLACK_FLAG = 0x1F3F4


def invisible() -> list[int]:
    """What is not seen, by rule: format characters but those that are seen, and the ignorable others."""
    seen = {cp for lo, hi in SEEN for cp in range(lo, hi + 1)}
    formats = [cp for cp in range(0xAD, 0xE0080) if unicodedata.category(chr(cp)) == "Cf" and cp not in seen]
    return sorted({*formats, *(cp for lo, hi in FILLERS for cp in range(lo, hi + 1))})


LATIN, CYR, GRE, OTHER = 1, 2, 3, 4


class Tables:
    """Lookup tables over all code points, made by rule from the Unicode database."""

    def __init__(self) -> None:
        self.first = np.arange(TOP, dtype=np.uint32)
        self.length = np.ones(TOP, np.int8)
        self.start = np.zeros(TOP, np.int32)
        pool: list[int] = []
        nfd_start, nfd_length = np.zeros(TOP, np.int32), np.zeros(TOP, np.int8)
        pairs: dict[int, int] = {}
        for cp in range(0xA0, 0x2FA20):
            if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp < 0xE000:
                continue
            c = chr(cp)
            d = unicodedata.decomposition(c)
            if not d:
                continue
            tag = d.split()[0] if d[0] == "<" else ""
            roman, ligature = 0x2160 <= cp <= 0x217F, 0xFB00 <= cp <= 0xFB06
            if tag in ("<wide>", "<narrow>", "<font>") or roman or ligature:
                self._put(cp, unicodedata.normalize("NFC", unicodedata.normalize("NFKC", c)), pool)
            elif not tag:
                parts = [int(x, 16) for x in d.split()]
                whole = unicodedata.normalize("NFC", c)
                if whole != c:
                    self._put(cp, whole, pool)
                elif len(parts) == 2:
                    pairs[(parts[0] << 21) | parts[1]] = cp
                if len(nfd := unicodedata.normalize("NFD", c)) > 1:
                    nfd_start[cp], nfd_length[cp] = len(pool), len(nfd)
                    pool += map(ord, nfd)
        for c in SPACES:
            self._put(ord(c), " ", pool)
        for c in HYPHENS:
            self._put(ord(c), "-", pool)
        for cp in invisible():
            self._put(cp, "", pool)
        self.pool = np.array(pool, np.uint32)
        self.nfd_start, self.nfd_length = nfd_start, nfd_length
        self.keys = np.array(sorted(pairs), np.int64)
        self.composed = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        self.ccc = np.zeros(TOP, np.uint8)
        self.script = np.zeros(TOP, np.int8)
        for cp in range(0x41, 0x323B0):
            if 0xD800 <= cp < 0xE000:
                continue
            c = chr(cp)
            self.ccc[cp] = unicodedata.combining(c)
            if (k := unicodedata.category(c))[0] == "L":
                self.script[cp] = OTHER
            elif k[0] == "M":
                self.script[cp] = -1
        for lo, hi, s in ((0x41, 0x24F, LATIN), (0x250, 0x2AF, LATIN), (0x1E00, 0x1EFF, LATIN), (0x370, 0x3FF, GRE), (0x1F00, 0x1FFF, GRE), (0x400, 0x52F, CYR)):
            at = np.arange(lo, hi + 1)
            self.script[at[self.script[at] == OTHER]] = s
        for c in "ªº":
            self.script[ord(c)] = OTHER
        self.emoji = np.zeros(TOP, bool)
        for lo, hi in ((0x1F000, 0x1FAFF), (0x2190, 0x21FF), (0x2300, 0x23FF), (0x25A0, 0x27BF), (0x2B00, 0x2BFF), (0xFE0E, 0xFE0F), (0xE0020, 0xE007F)):
            self.emoji[lo : hi + 1] = True
        for cp in (0xA9, 0xAE, 0x203C, 0x2049, 0x2122, 0x20E3):
            self.emoji[cp] = True
        self.selected = self.emoji.copy()
        for c in "0123456789#*":
            self.selected[ord(c)] = True
        #: Scripts in which joiners between letters belong to the writing.
        self.joins = np.zeros(TOP, bool)
        for lo, hi in ((0x600, 0x8FF), (0x900, 0xDFF), (0xF00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x18AF)):
            self.joins[lo : hi + 1] = True
        self.latin = np.zeros(TOP, np.uint32)
        self.cyrillic = np.zeros(TOP, np.uint32)
        self.greek = np.zeros(TOP, np.uint32)
        for c, like in CYRILLIC.items():
            self.latin[ord(c)] = ord(like)
            if c not in FOREIGN:
                self.cyrillic[ord(like)] = ord(c)
        for c, like in GREEK.items():
            self.latin[ord(c)] = ord(like)
            self.greek[ord(like)] = ord(c)
        for c, like in CYRILLIC.items():
            if self.greek[ord(like)]:
                self.greek[ord(c)] = self.greek[ord(like)]
        for c, like in GREEK.items():
            if self.cyrillic[ord(like)]:
                self.cyrillic[ord(c)] = self.cyrillic[ord(like)]
        self.foreign = np.zeros(TOP, bool)
        self.foreign[[ord(c) for c in FOREIGN]] = True

    def _put(self, cp: int, text: str, pool: list[int]) -> None:
        self.length[cp], self.start[cp] = len(text), len(pool)
        if len(text) == 1:
            self.first[cp] = ord(text)
        pool += map(ord, text)


@cache
def tables() -> Tables:
    return Tables()


def _row_of(at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def _offsets(rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def _expand(codes: np.ndarray, rows: np.ndarray, length: np.ndarray, start: np.ndarray, pool: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces each code point by ``length`` ones: its ``single`` where that is 1, else a piece of the pool."""
    end = np.cumsum(length)
    out = np.repeat(single, length)
    if (many := np.flatnonzero(length > 1)).size:
        n = length[many]
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(end[many] - n, n) + off] = pool[np.repeat(start[many], n) + off]
    return out, np.repeat(rows, length)


def _without_invisible(t: Tables, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Lengths after replacement, with the joiners and selectors kept that belong there."""
    length = t.length[codes].astype(np.int64)
    odd = np.flatnonzero((length == 0) & ((codes == 0x200C) | (codes == 0x200D) | (codes == 0xFE0F) | (codes == 0xFE0E)))
    if odd.size:
        last = len(codes) - 1
        before, after = np.maximum(odd - 1, 0), np.minimum(odd + 1, last)
        b = np.where((odd > 0) & (rows[before] == rows[odd]), codes[before], 0)
        a = np.where((odd < last) & (rows[after] == rows[odd]), codes[after], 0)
        joiner = codes[odd] == 0x200D
        keep = joiner & t.emoji[b] & t.emoji[a] & (a != 0xFE0F) & (a != 0xFE0E)
        keep |= (codes[odd] <= 0x200D) & t.joins[b] & t.joins[a]
        keep |= (codes[odd] >= 0xFE0E) & t.selected[b] & (b != 0xFE0F) & (b != 0xFE0E)
        length[odd[keep]] = 1
    tag = (codes >= TAGS[0]) & (codes <= TAGS[1])
    if tag.any():
        # Tags behind a flag name a region; anywhere else they are hidden text.
        base = np.maximum.accumulate(np.where(tag, -1, np.arange(len(codes))))
        length[tag & (base >= 0) & (rows[np.maximum(base, 0)] == rows) & (codes[np.maximum(base, 0)] == BLACK_FLAG)] = 1
    return length


def _compose(t: Tables, codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition."""
    ccc = t.ccc[codes]
    if ccc.any():
        # A composed letter before a further mark is taken apart first, so that marks can be ordered.
        nxt = np.zeros(len(codes), bool)
        nxt[:-1] = (ccc[1:] > 0) & (rows[1:] == rows[:-1])
        length = np.where(nxt & (t.nfd_length[codes] > 0), t.nfd_length[codes], 1).astype(np.int64)
        if (length > 1).any():
            codes, rows = _expand(codes, rows, length, t.nfd_start[codes], t.pool, codes)
            ccc = t.ccc[codes]
        if ((ccc[:-1] > ccc[1:]) & (ccc[1:] > 0) & (rows[1:] == rows[:-1])).any():
            starter = np.cumsum((ccc == 0) | np.concatenate([[True], rows[1:] != rows[:-1]]))
            order = np.lexsort((ccc, starter))
            codes, rows, ccc = codes[order], rows[order], ccc[order]
    while len(codes) > 1:
        i = np.arange(1, len(codes))
        starters = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(codes)), -1))
        s = starters[:-1]
        near = s == i - 1
        ok = (s >= 0) & (rows[np.maximum(s, 0)] == rows[1:]) & (near | ((ccc[1:] > 0) & (ccc[:-1] < ccc[1:]) & (ccc[:-1] > 0)))
        i, s = i[ok], s[ok]
        a, b = codes[s].astype(np.int64), codes[i].astype(np.int64)
        made = np.zeros(len(i), np.uint32)
        key = (a << 21) | b
        at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        made = np.where(t.keys[at] == key, t.composed[at], 0).astype(np.uint32)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        made = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28, made)
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        made = np.where(lvt, a + (b - 0x11A7), made).astype(np.uint32)
        hit = np.flatnonzero(made)
        if not hit.size:
            break
        i, s, made = i[hit], s[hit], made[hit]
        # One step per starter and round; a starter that is itself taken in waits for the next round.
        _, one = np.unique(s, return_index=True)
        i, s, made = i[one], s[one], made[one]
        free = ~np.isin(s, i)
        i, s, made = i[free], s[free], made[free]
        codes = codes.copy()
        codes[s] = made
        keep = np.ones(len(codes), bool)
        keep[i] = False
        codes, rows = codes[keep], rows[keep]
        ccc = t.ccc[codes]
    return codes, rows


def _scripts(t: Tables, codes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Look-alike letters in the script that their word is in."""
    script = t.script[codes]
    letter = script != 0
    if not ((script == CYR) | (script == GRE)).any():
        return codes
    begin = letter & ~np.concatenate([[False], letter[:-1] & (rows[1:] == rows[:-1])])
    word = np.cumsum(begin) - 1
    at = np.flatnonzero(letter & (script > 0))
    w, s, c, r = word[at], script[at], codes[at], rows[at]
    n_words = int(word[-1]) + 1 if len(word) else 0

    def per(flag: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of[flag], minlength=n)

    latin_sure = (s == LATIN) & (t.cyrillic[c] == 0)
    latin_sure_g = (s == LATIN) & (t.greek[c] == 0)
    cyr_sure, gre_sure = (s == CYR) & (t.latin[c] == 0), (s == GRE) & (t.latin[c] == 0)
    lat, cyr, gre = (per(s == k, w, n_words) for k in (LATIN, CYR, GRE))
    ls, lsg, cs, gs = (per(x, w, n_words) for x in (latin_sure, latin_sure_g, cyr_sure, gre_sure))
    alien = per(t.foreign[c], w, n_words)
    rl, rc, rg = (per(x, r, n_rows) for x in (latin_sure & latin_sure_g, cyr_sure, gre_sure))
    row = np.zeros(n_words, np.int64)
    row[w] = r
    rl, rc, rg = rl[row], rc[row], rg[row]
    kinds = (lat > 0).astype(int) + (cyr > 0) + (gre > 0)
    target = np.zeros(n_words, np.int8)
    suspect = (kinds > 1) | ((kinds == 1) & (lat == 0) & (cs == 0) & (gs == 0))
    # The word's own sure letters decide; the more, where they disagree.
    sure_lat = np.where(gs > 0, lsg, ls)
    by_word = np.select([(sure_lat > 0) & (sure_lat >= cs) & (sure_lat >= gs), (cs > 0) & (cs >= gs), gs > 0], [LATIN, CYR, GRE], 0)
    # Without any, those of the field; foreign look-alikes count for Latin.
    single = np.where(cyr > 0, CYR, GRE)
    own = np.where(single == CYR, rc, rg)
    by_row = np.select(
        [alien > 0, (kinds == 1) & (own > 0), (kinds == 1) & (rl > 0), kinds == 1, rl > 0, rc > 0, rg > 0, (lat >= cyr) & (lat >= gre), cyr >= gre],
        [LATIN, single, LATIN, single, LATIN, CYR, GRE, LATIN, LATIN], LATIN,
    )
    target = np.where(suspect, np.where(by_word > 0, by_word, by_row), 0)
    goal = target[w]
    new = c.copy()
    for k, table in ((LATIN, t.latin), (CYR, t.cyrillic), (GRE, t.greek)):
        change = (goal == k) & (s != k) & (s < OTHER) & (table[c] > 0)
        new[change] = table[c[change]]
    out = codes.copy()
    out[at] = new
    return out


def plain_codes(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kernel: code points and row offsets in, the same in the plain form out."""
    t, n = tables(), len(at) - 1
    rows = _row_of(at)
    length = _without_invisible(t, codes, rows)
    codes, rows = _expand(codes, rows, length, t.start[codes], t.pool, np.where(t.length[codes] == 0, codes, t.first[codes]).astype(np.uint32))
    codes, rows = _compose(t, codes, rows)
    codes = _scripts(t, codes, rows, n)
    # A letter that changed its script may now take the mark after it.
    codes, rows = _compose(t, codes, rows)
    return codes, _offsets(rows, n)


def plain_column(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(plain column, places of the rows that changed). Rows of ASCII alone are not touched."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    raw, at = string_buffers(col)
    rows = np.flatnonzero(any_in(raw >= 0x80, at))
    if not rows.size:
        return col, rows
    part, part_at = take_rows(raw, at, rows)
    codes, code_at = to_codes(part, part_at)
    new, new_at = plain_codes(codes, code_at)
    plain = from_codes(new, new_at)
    old = col.take(pa.array(rows)).cast(pa.string())
    differs = np.flatnonzero(pc.not_equal(old, plain).to_numpy(zero_copy_only=False))
    rows, plain = rows[differs], plain.take(pa.array(differs))
    mask = np.zeros(len(col), bool)
    mask[rows] = True
    return pc.replace_with_mask(col.cast(pa.string()), pa.array(mask), plain), rows


def changed(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The fields that have another plain form: key, field, original, plain. A key named like one of the others
    gets an underscore behind its name."""
    from pyspark.sql import functions as F

    source = df.select(F.col(key).alias("k"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    key = key + "_" if key in ("field", "original", "plain") else key
    out = T.StructType([T.StructField(key, source.schema["k"].dataType), T.StructField("field", T.StringType()), T.StructField("original", T.StringType()), T.StructField("plain", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, f in enumerate(fields):
                plain, rows = plain_column(b.column(i + 1))
                if rows.size:
                    pick = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pick), pa.array([f] * len(rows), pa.string()), b.column(i + 1).take(pick).cast(pa.string()), plain.take(pick)], [key, "field", "original", "plain"])

    return source.mapInArrow(run, out)


def normalised(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with the given columns in their plain form; all other columns as they are."""
    places = [df.columns.index(f) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            for p in places:
                cols[p] = plain_column(cols[p])[0]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return df.mapInArrow(run, df.schema)
