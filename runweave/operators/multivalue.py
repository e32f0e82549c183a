"""Several values packed in one field: one row per value, with its position.

An Arrow batch's text is one byte buffer. Quote parity, delimiters and protected names are
masks over that buffer; where delimiters begin and end gives the offsets of the children, and a
gather gives the list array's values, flattened with the ordinal of the parent. No step is done row by row.

What parts values is a parameter (``Delimiters``): symbols, words that always part values, and words that do so only with a value
on either side; words stand between blanks (also after an opening bracket). What does not part values: anything inside a pair
of quotation marks put around a value, anything inside a protected name, a word with nothing on one side, and a comma
before a single initial, article, prefix or given name ("Derakost, Thomas"; "Motor Quartet, The").

Protected names come from a register of any size, which is joined and never collected: every stretch of a text's words that
holds a delimiter is a row, as is every single word after a comma, and an equi-join finds those that are names of the register
(or first words of several of its names). Of overlapping names the first one counts, and of those the longest.
Only texts that hold a delimiter take part, each once; the rows are joined to their stretches with a salt.

Edge cases: null and empty fields give no rows; a field with one value gives one row; empty
values between delimiters are left out and take no position; an odd number of double
quotes in a field means they are text, as does an opening mark without a closing one; repeated rows are split alike; texts of any length
are handled by the same array steps; an empty table gives an empty table; a key
column named pos, n or name gets an underscore behind its name in the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.operators.joins import spread_join
from runweave.session import cut


@dataclass(frozen=True)
class Delimiters:
    """symbols: part values wherever they stand. always, between: words that part values, the latter only with a value on either
    side. quotes: pairs of marks that keep what is between them whole, beside " and ' (which open and close alike)."""

    symbols: tuple[str, ...] = (",", ";", "/", "|", "&", "+", "\n", "\\", "·", "•", "×", "，", "、", "；", "／", "｜", "＆", "＋")
    always: tuple[str, ...] = ("feat.", "feat", "ft.", "ft", "featuring", "w/", "vs.", "b2b")
    between: tuple[str, ...] = ("x", "vs", "and", "with", "versus", "meets", "pres.")
    quotes: tuple[tuple[str, str], ...] = (("“", "”"), ("„", "“"), ("«", "»"), ("「", "」"))

    def pattern(self) -> str:
        """A Java pattern that finds something in every text that can be parted; it may find more."""
        words = "|".join(map(re.escape, sorted({*self.always, *self.between})))
        return rf"[{''.join(map(re.escape, self.symbols))}]|(?i)(?:[\s(\[{{]|^)(?:{words})\s"


DEFAULT = Delimiters()
PREFIXES = frozenset({"the", "dj", "mc", "les"})

_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n\x0b\x0c")] = True
_OPEN = np.zeros(256, bool)
_OPEN[list(b"([{")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b")]}")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
END = 0
NAME, WORD = 0, 1


def _find(buf: np.ndarray, text: bytes) -> np.ndarray:
    """Where ``text`` stands in the buffer."""
    if len(buf) < len(text):
        return np.empty(0, np.int64)
    at = np.flatnonzero(buf[: len(buf) - len(text) + 1] == text[0])
    for k, c in enumerate(text[1:], 1):
        at = at[buf[at + k] == c]
    return at


def _cover(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mask of ``n`` bytes over the stretches."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


class _Buffer:
    """The texts of a batch as bytes, with what stands where."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, delimiters: Delimiters) -> None:
        self.n_rows = len(at) - 1
        sizes = np.diff(at)
        # A zero byte ends each row, so that no look at a neighbour leaves the row.
        self.starts = at[:-1] + np.arange(self.n_rows)
        buf = self.buf = np.full(len(raw) + self.n_rows, END, np.uint8)
        self.row = np.repeat(np.arange(self.n_rows), sizes + 1)
        body = np.ones(len(buf), bool)
        body[self.starts + sizes] = False
        buf[body] = np.where(raw == END, 32, raw)
        self.low, self.n = _LOWER[buf], len(buf)
        self.prev, self.nxt = np.concatenate([[END], buf[:-1]]), np.concatenate([buf[1:], [END]])
        self.symbol = np.zeros(self.n, bool)
        for s in delimiters.symbols:
            b = s.encode()
            hit = _find(buf, b)
            for k in range(len(b)):
                self.symbol[hit + k] = True
        self.stop = self.symbol | (buf == END) | _BLANK[buf]
        self.after_stop = np.concatenate([[True], self.stop[:-1]])
        self.before_stop = np.concatenate([self.stop[1:], [True]])

    def words(self, first: np.ndarray, words: Iterable[str]) -> Iterator[tuple[np.ndarray, int]]:
        """(places, length) of the delimiter words among the places ``first``; a blank follows them."""
        for w in words:
            b = w.lower().encode()
            hit = first[first + len(b) < self.n]
            for k, c in enumerate(b):
                hit = hit[self.low[hit + k] == c]
            yield hit[_BLANK[self.buf[hit + len(b)]]], len(b)

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and row of runs without blanks, symbols, brackets and quotation marks."""
        free = ~(self.stop | _OPEN[self.buf] | _CLOSE[self.buf] | (self.buf == 34) | (self.buf == 39))
        begin = np.flatnonzero(free & ~np.concatenate([[False], free[:-1]]))
        end = np.flatnonzero(free & ~np.concatenate([free[1:], [False]])) + 1
        return begin, end, self.row[begin]

    def keys(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """The stretches in lower case with single blanks."""
        blank = _BLANK[self.buf]
        text = np.where(blank, 32, self.buf).astype(np.uint8)
        return pc.utf8_lower(_gather(text, begin, end, ~(blank & np.concatenate([[False], blank[:-1]]))))


def stretches(raw: np.ndarray, at: np.ndarray, longest: int, delimiters: Delimiters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, kind, begin, end, key) of what a register may know: stretches of up to ``longest`` words that hold a delimiter, and
    single words after a comma. Places count from the row's begin."""
    b = _Buffer(raw, at, delimiters)
    begin, end, row = b.tokens()
    held = b.symbol.astype(np.int64)
    for hit, _ in b.words(begin, (*delimiters.always, *delimiters.between)):
        held[hit] = 1
    last = np.flatnonzero(b.nxt == END)  # a word that ends its row has no blank behind it
    for w in (*delimiters.always, *delimiters.between):
        e = w.lower().encode()
        tail = begin[(end - begin == len(e)) & np.isin(end - 1, last)]
        for k, c in enumerate(e):
            tail = tail[b.low[tail + k] == c]
        held[tail] = 1
    held = np.concatenate([[0], np.cumsum(held)])
    lo, hi = [], []
    for k in range(min(longest, len(begin))):
        i = np.arange(len(begin) - k)
        i = i[row[i] == row[i + k]]
        if not i.size:
            break
        i = i[held[end[i + k]] > held[begin[i]]]
        lo.append(begin[i])
        hi.append(end[i + k])
    names = (np.concatenate(lo), np.concatenate(hi)) if lo else (begin[:0], end[:0])
    comma = np.flatnonzero((b.buf[:-1] == 44) & _BLANK[b.buf[1:]]) if b.n > 1 else np.empty(0, np.int64)
    near = np.searchsorted(begin, comma)
    comma, near = comma[near < len(begin)], near[near < len(begin)]
    single = near[(begin[near] - comma <= 3) & (row[near] == b.row[comma])] if len(begin) else near
    lo, hi = np.concatenate([names[0], begin[single]]), np.concatenate([names[1], end[single]])
    kind = np.concatenate([np.full(len(names[0]), NAME), np.full(len(single), WORD)])
    of = b.row[lo] if len(lo) else lo
    return of, kind, lo - b.starts[of], hi - b.starts[of], b.keys(lo, hi)


def cores(raw: np.ndarray, at: np.ndarray, delimiters: Delimiters) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, key, words) of names: from their first word to their last, as ``stretches`` has them."""
    b = _Buffer(raw, at, delimiters)
    begin, end, row = b.tokens()
    if not len(begin):
        return row, pa.array([], pa.string()), row
    first = np.concatenate([[True], row[1:] != row[:-1]])
    last = np.concatenate([row[1:] != row[:-1], [True]])
    return row[first], b.keys(begin[first], end[last]), np.flatnonzero(last) - np.flatnonzero(first) + 1


class Splitter:
    """given: single words that after a comma belong to the value before it, beside those found in the register."""

    def __init__(self, given: Iterable[str] = (), delimiters: Delimiters = DEFAULT) -> None:
        self.given = pa.array(sorted({g.lower() for g in given} | PREFIXES), pa.string())
        self.delimiters = delimiters

    # masks -----------------------------------------------------------------------------

    def _quoted(self, b: _Buffer, edge_left: np.ndarray, edge_right: np.ndarray) -> np.ndarray:
        """Inside quotation marks. Double ones by parity within the row; single ones from one that opens a
        value to the next that closes one; pairs from an opening mark to the next closing one."""
        buf, row = b.buf, b.row
        double = buf == 34
        count = np.bincount(row[double], minlength=b.n_rows)
        double &= (count % 2 == 0)[row]
        running = np.cumsum(double)
        base = np.concatenate([[0], np.cumsum(np.where(count % 2 == 0, count, 0))])[:-1]
        inside = ((running - base[row]) % 2 == 1) | double
        single = np.flatnonzero((buf == 39) & ~inside)
        opens, closes = single[edge_left[single] & ~edge_right[single]], single[edge_right[single] & ~edge_left[single]]
        inside |= self._between(b, opens, closes, 1)
        if (buf >= 0x80).any():
            for o, c in self.delimiters.quotes:
                inside |= self._between(b, _find(buf, o.encode()), _find(buf, c.encode()), len(c.encode()))
        return inside

    @staticmethod
    def _between(b: _Buffer, opens: np.ndarray, closes: np.ndarray, length: int) -> np.ndarray:
        """From each opening mark to the next closing one of its row; of several openings before one closing the first counts."""
        if not (opens.size and closes.size):
            return np.zeros(b.n, bool)
        nxt = np.searchsorted(closes, opens, side="right")
        opens, nxt = opens[nxt < len(closes)], nxt[nxt < len(closes)]
        ends = closes[nxt]
        ok = b.row[opens] == b.row[ends]
        ends, first = np.unique(ends[ok], return_index=True)
        return _cover(b.n, opens[ok][first], ends + length)

    @staticmethod
    def _first_names(begin: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Places of the names that count, of those that overlap; begin and end count in the whole buffer."""
        order = np.lexsort((-end, begin))
        b, e, r = begin[order], end[order], row[order]
        after = np.searchsorted(b, e)
        kept = []
        at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.empty(0, np.int64)
        while at.size:
            kept.append(at)
            to = after[at]
            ok = (to < len(r)) & (r[np.minimum(to, len(r) - 1)] == r[at])
            at = to[ok]
        return order[np.concatenate(kept)] if kept else order

    def split(self, raw: np.ndarray, at: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, pa.Array]:
        """Bytes and row offsets to (parent row, value), in order. known: row, kind, begin, end of what the register knows."""
        b = _Buffer(raw, at, self.delimiters)
        buf, low, row, n, prev, stop = b.buf, b.low, b.row, b.n, b.prev, b.stop
        guarded = self._quoted(b, b.after_stop | _OPEN[prev], b.before_stop | _CLOSE[b.nxt])
        given_end = np.full(n, -1, np.int64)
        if known is not None and len(known[0]):
            of, kind, lo, hi = known
            lo, hi = lo + b.starts[of], hi + b.starts[of]
            given_end[lo[kind == WORD]] = hi[kind == WORD]
            lo, hi, of = lo[kind == NAME], hi[kind == NAME], of[kind == NAME]
            first = self._first_names(lo, hi, of)
            guarded |= _cover(n, lo[first], hi[first])
        cut = b.symbol & ~guarded
        # Words: only where a blank or bracket stands before them.
        first = np.flatnonzero((_BLANK[prev] | _OPEN[prev]) & ~stop & ~guarded)
        weak = np.zeros(n, bool)
        for words, always in ((self.delimiters.always, True), (self.delimiters.between, False)):
            for hit, length in b.words(first, words):
                if not always:
                    hit = hit[_BLANK[prev[hit]]]
                for k in range(length):
                    cut[hit + k] = True
                    if not always:
                        weak[hit + k] = True
                opened = hit[_OPEN[prev[hit]]] - 1
                cut[opened] = True
        cut = self._settle(cut, weak, buf, low)
        begin, end, parent = self._pieces(cut, buf, row)
        glued = self._sort_forms(buf, cut, guarded, begin, end, parent, given_end)
        if glued.size:
            cut[glued] = False
            begin, end, parent = self._pieces(cut, buf, row)
        return self._values(b, begin, end, parent)

    @staticmethod
    def _settle(cut: np.ndarray, weak: np.ndarray, buf: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Words that need a value on either side and have none are text; after a symbol only capitals are."""
        if not weak.any():
            return cut
        solid = ~_BLANK[buf]
        index = np.arange(len(buf))
        before = np.maximum.accumulate(np.where(solid, index, -1))
        after = np.minimum.accumulate(np.where(solid, index, len(buf))[::-1])[::-1]
        head = np.flatnonzero(weak & ~np.concatenate([[False], weak[:-1]]))
        tail = np.flatnonzero(weak & ~np.concatenate([weak[1:], [False]]))
        p = np.where(head > 0, before[np.maximum(head - 1, 0)], -1)
        q = after[np.minimum(tail + 1, len(buf) - 1)]
        outside = lambda i: (i < 0) | (i >= len(buf)) | (buf[np.clip(i, 0, len(buf) - 1)] == END)
        no_left, no_right = outside(p), outside(q)
        on_left = ~no_left & cut[np.clip(p, 0, len(buf) - 1)]
        on_right = ~no_right & cut[np.clip(q, 0, len(buf) - 1)]
        capital = buf[head] != low[head]
        text = no_left | no_right | on_right | (on_left & capital)
        return cut & ~_cover(len(buf), head[text], tail[text] + 1)

    @staticmethod
    def _pieces(cut: np.ndarray, buf: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trimmed, non-empty stretches between delimiters: begin, end (exclusive), row."""
        wall = cut | (buf == END)
        free = ~wall & ~_BLANK[buf]
        # The number of the gap that a byte is in; the solid bytes of a gap bound its value.
        gap = np.cumsum(wall)
        at = np.flatnonzero(free)
        if not at.size:
            z = np.empty(0, np.int64)
            return z, z, z
        g = gap[at]
        lead = np.concatenate([[True], g[1:] != g[:-1]])
        trail = np.concatenate([g[1:] != g[:-1], [True]])
        return at[lead], at[trail] + 1, row[at[lead]]

    def _sort_forms(self, buf: np.ndarray, cut: np.ndarray, guarded: np.ndarray, begin: np.ndarray, end: np.ndarray, parent: np.ndarray, given_end: np.ndarray) -> np.ndarray:
        """Commas inside a name written with its first part last."""
        if len(begin) < 2:
            return np.empty(0, np.int64)
        left, right = np.arange(len(begin) - 1), np.arange(1, len(begin))
        between = begin[right] - end[left]
        ok = (parent[left] == parent[right]) & (buf[end[left]] == 44) & (between >= 2) & (between <= 3) & (end[left] - begin[left] >= 3) & ~guarded[begin[right]] & ~guarded[begin[left]]
        commas = np.concatenate([[0], np.cumsum(cut)])
        ok &= commas[begin[right]] - commas[end[left]] == 1
        at = np.flatnonzero(ok)
        if not at.size:
            return at
        texts = _gather(buf, begin[right[at]], end[right[at]], None)
        low = pc.utf8_lower(texts)
        single = pc.or_(pc.is_in(low, self.given), pc.match_substring_regex(texts, r"^\p{L}\.?$"))
        at = at[single.to_numpy(zero_copy_only=False) | (given_end[begin[right[at]]] == end[right[at]])]
        return end[left[at]]

    def _values(self, b: _Buffer, begin: np.ndarray, end: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        buf = b.buf
        opened, closed = (np.concatenate([[0], np.cumsum(x[buf])]) for x in (_OPEN, _CLOSE))
        begin, end = begin.copy(), end.copy()
        for _ in range(3):  # brackets that were opened before the delimiter
            loose = (end > begin) & _CLOSE[buf[np.maximum(end - 1, 0)]] & (closed[end] - closed[begin] > opened[end] - opened[begin])
            if not loose.any():
                break
            end[loose] -= 1
            while (blank := (end > begin) & _BLANK[buf[np.maximum(end - 1, 0)]] & loose).any():
                end[blank] -= 1
        some = end > begin
        begin, end, parent = begin[some], end[some], parent[some]
        keep = np.ones(len(buf), bool)
        if len(begin):
            for q in (34, 39):
                marks = np.concatenate([[0], np.cumsum(buf == q)])
                twin = (buf == q) & np.concatenate([[False], buf[:-1] == q])
                twins = np.concatenate([[0], np.cumsum(twin)])
                inner = marks[np.maximum(end - 1, begin + 1)] - marks[np.minimum(begin + 1, end)]
                doubled = twins[np.maximum(end - 1, begin + 1)] - twins[np.minimum(begin + 2, end)]
                whole = (end - begin > 2) & (buf[begin] == q) & (buf[end - 1] == q) & (inner == 2 * doubled)
                keep[begin[whole]] = keep[end[whole] - 1] = False
                keep &= ~(twin & _cover(len(buf), begin[whole] + 1, end[whole] - 1))
            if (buf >= 0x80).any():
                for o, c in self.delimiters.quotes:
                    o, c = o.encode(), c.encode()
                    opens, closes = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
                    opens[_find(buf, o)] = True
                    closes[_find(buf, c) + len(c)] = True
                    many = np.cumsum(closes)
                    whole = opens[begin] & closes[end] & (many[end] - many[begin] == 1) & (end - begin > len(o) + len(c))
                    begin, end = begin + len(o) * whole, end - len(c) * whole
        texts = pc.utf8_trim(_gather(buf, begin, end, keep), characters=" \t\r\n")
        return parent, texts

    def lists(self, col: pa.Array, known: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.ListArray:
        """The values of each row of a string column as a list array."""
        parent, texts = self.split(*_buffers(col), known)
        ends = np.cumsum(np.bincount(parent, minlength=len(col)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), texts)


def _gather(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, keep: np.ndarray | None) -> pa.Array:
    """The stretches as strings, without the bytes that ``keep`` leaves out."""
    size = end - begin
    off = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(begin - off[:-1], size) + np.arange(off[-1])
    if keep is not None:
        held = keep[index]
        off = np.concatenate([[0], np.cumsum(held)])[off]
        index = index[held]
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(buf[index].tobytes()))


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.string()).fill_null("") if col.null_count else col.cast(pa.string())
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    at = np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


_SPANS = "array<struct<kind:int,begin:int,end:int>>"


def _as_table(names: DataFrame | Iterable[str], like: DataFrame) -> DataFrame | None:
    """A column ``name`` of a table or of a few names at hand."""
    if isinstance(names, DataFrame):
        return names.select(F.col(names.columns[0]).cast("string").alias("name"))
    names = sorted({n for n in names if n})
    return like.sparkSession.createDataFrame([(n,) for n in names], "name string") if names else None


def _core_rows(names: DataFrame, delimiters: Delimiters) -> DataFrame:
    """key, words of the names that hold a delimiter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, key, words = cores(*_buffers(b.column(0)), delimiters)
            yield pa.RecordBatch.from_arrays([key, pa.array(words, pa.int64())], ["key", "words"])

    return names.where(F.concat(F.col("name"), F.lit(" ")).rlike(delimiters.pattern())).mapInArrow(run, "key string, words bigint").where("key <> ''").distinct()


def _known(texts: DataFrame, names: DataFrame | None, given: DataFrame | None, delimiters: Delimiters) -> DataFrame:
    """v, spans of the texts in which something of the register stands."""
    keys = texts.sparkSession.createDataFrame([], "kind int, key string")
    longest = 0
    if names is not None:
        held = cut(_core_rows(names, delimiters))
        longest = held.agg(F.max("words")).first()[0] or 0
        keys = keys.unionByName(held.select(F.lit(NAME).alias("kind"), "key").distinct())
    if given is not None:
        keys = keys.unionByName(given.select(F.lit(WORD).alias("kind"), F.lower("name").alias("key")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, kind, begin, end, key = stretches(*_buffers(b.column(0)), longest, delimiters)
            ints = [pa.array(x, pa.int32()) for x in (kind, begin, end)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *ints, key], ["v", "kind", "begin", "end", "key"])

    found = texts.select("v").mapInArrow(run, "v string, kind int, begin int, end int, key string").join(keys, ["kind", "key"])
    return found.groupBy("v").agg(F.collect_list(F.struct("kind", "begin", "end")).alias("spans"))


def _whole(texts: DataFrame, names: DataFrame, delimiters: Delimiters) -> DataFrame:
    """The texts that are one of the names in any case, blanks and punctuation. Letters outside ASCII may stand for any letter of the name, as
    long as some of the text is ASCII: such texts are met by their first three letters in ASCII in a row (or the first one) and the place of these."""
    held = names.where(F.concat(F.col("name"), F.lit(" ")).rlike(delimiters.pattern())).select(letters(F.col("name")).alias("l")).where("l <> ''").distinct()
    own = texts.select("v", letters(F.col("v")).alias("l"))
    same = own.join(held, "l", "left_semi").select("v")
    foreign = own.where(F.col("l").rlike(r"[^\x00-\x7F]") & F.col("l").rlike("[a-z]")).select("v", F.regexp_replace("l", r"[^\x00-\x7F]", "_").alias("wild"))
    three = F.regexp_extract("wild", "[a-z0-9]{3}", 0)
    foreign = foreign.withColumn("gram", F.when(three != "", three).otherwise(F.regexp_extract("wild", "[a-z0-9]", 0)))
    foreign = foreign.select("v", "wild", "gram", F.instr("wild", F.col("gram")).alias("at"), F.length("wild").alias("n"))
    places = held.select("l", F.length("l").alias("n"), F.explode(F.sequence(F.lit(1), F.length("l"))).alias("at"))
    grams = places.select("l", "n", "at", F.explode(F.array(F.substring("l", F.col("at"), F.lit(1)), F.substring("l", F.col("at"), F.lit(3)))).alias("gram")).distinct()
    loosely = foreign.join(grams, ["n", "at", "gram"]).where("l LIKE wild").select("v")
    return same.unionByName(loosely).distinct()


def split_values(
    df: DataFrame, key: str, field: str, *, protected: DataFrame | Iterable[str] = (), given: DataFrame | Iterable[str] = (), least: int = 1, whole: DataFrame | Iterable[str] = (), delimiters: Delimiters = DEFAULT
) -> DataFrame:
    """key, pos (from 1), n (values in the field), name; only fields with at least ``least`` values.

    protected: names that are one value though they hold delimiters. given: words that after a comma belong to the value before it. whole:
    fields that are one of these names in any writing are one value; this is looked at only where ``least`` asks for several. Each is a
    table of any size, whose first column counts, or a few texts."""
    out_key = key + "_" if key in ("pos", "n", "name") else key
    source = df.select(F.col(key).alias("k"), F.col(field).cast("string").alias("v")).where("v IS NOT NULL AND v <> ''")
    out = T.StructType([T.StructField(out_key, source.schema["k"].dataType), T.StructField("pos", T.LongType()), T.StructField("n", T.LongType()), T.StructField("name", T.StringType())])
    names, few = _as_table(protected, df), () if isinstance(given, DataFrame) else tuple(given)
    words = given if isinstance(given, DataFrame) else None
    wholes = _as_table(whole, df) if least > 1 else None
    splitter = Splitter(few, delimiters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = None
            if b.num_columns > 2:
                spans = b.column(2)
                flat = pc.list_flatten(spans)
                known = (pc.list_parent_indices(spans).to_numpy().astype(np.int64), *(flat.field(i).to_numpy().astype(np.int64) for i in range(3)))
            lists = splitter.lists(b.column(1), known)
            rows = np.flatnonzero(pc.list_value_length(lists).to_numpy() >= max(1, least))
            if not rows.size:
                continue
            lists = lists.take(pa.array(rows))
            parent = pc.list_parent_indices(lists).to_numpy()
            n = pc.list_value_length(lists).to_numpy().astype(np.int64)
            pos = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n) + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[parent])), pa.array(pos, pa.int64()), pa.array(n[parent]), pc.list_flatten(lists)], [out_key, "pos", "n", "name"])

    # A text without any delimiter is one value.
    may = F.col("v").rlike(delimiters.pattern())
    if names is None and words is None and wholes is None:
        return source.where(may if least > 1 else F.lit(True)).mapInArrow(run, out)
    texts = cut(source.where(may).select("v").distinct())
    info = _known(texts, names, words, delimiters)
    if wholes is not None:
        info = info.join(_whole(texts, wholes, delimiters).withColumn("one", F.lit(True)), "v", "full")
    else:
        info = info.withColumn("one", F.lit(None).cast("boolean"))
    rows = spread_join(source.where(may), info, "v", "k").where("one IS NULL").select("k", "v", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    parted = rows.mapInArrow(run, out)
    return parted if least > 1 else parted.unionByName(source.where(~may).mapInArrow(run, out))


def letters(text: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def given_names(names: Iterable[str], least: int = 2) -> set[str]:
    """First words that begin several names of two words or more, of a few names at hand."""
    from collections import Counter

    count = Counter(n.split()[0].lower() for n in names if n and len(n.split()) > 1)
    return {w for w, k in count.items() if k >= least and w.isalpha()}


def given_words(names: DataFrame, least: int = 2) -> DataFrame:
    """The same of a register of any size: a column ``name``."""
    word = F.lower(F.regexp_extract("name", r"(?U)^\s*(\p{L}+)\s+\S", 1))
    return names.select(word.alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("name")


def exchanged(rows: DataFrame, key: str, artist: str, title: str, register: DataFrame) -> DataFrame:
    """key of the rows in which artist and title stand in each other's place, by what the row itself shows: the title is, in any writing, a name of
    the register, and the artist is none. The register (its first column) is joined, never collected."""
    names = register.select(letters(F.col(register.columns[0]).cast("string")).alias("l")).where("l <> ''").distinct()
    own = rows.select(F.col(key).alias("k"), letters(F.coalesce(F.col(artist), F.lit(""))).alias("a"), letters(F.coalesce(F.col(title), F.lit(""))).alias("l"))
    turned = spread_join(own.where("l <> ''"), names.withColumn("known", F.lit(True)), "l", "k").where("known")
    return spread_join(turned.drop("known"), names.select(F.col("l").alias("a")), "a", "k", "left_anti").select(F.col("k").alias(key))
