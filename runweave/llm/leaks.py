"""Evaluation texts inside a corpus: an FM-index per shard of documents.

The words of the passages are the alphabet. A shard's text is the words of its documents as
symbols; stretches with under ``seed`` known words in a row cannot hold a phrase of ``seed``
words and are left out of the index, their place taken by a separator, so the index is a
fraction of the text and still finds every occurrence. All phrases of the passages are searched
backward at once, and their occurrences are located from sampled suffix positions.

Candidates: a stretch of ``least`` words with one word in eight changed, added or missing keeps at least
least - seed + 1 - seed * ceil(least / 8) phrases whole (five, for 20 words and phrases of four). Pairs of document
and passage with so many hits on a chain of near diagonals are aligned word by word over the whole chain; what is found is merged
to removal spans in words and characters.

Passages without the sentences that begin several of them (instructions) are compared. As passages may be
built on common sentence patterns, a stretch is weighed by its phrases of three words that at most two passages have (its own ones): the fewer
of its words agree, the more of its own phrases must. A stretch with seven words in eight needs four in ten of them, one with three in four needs two thirds. Of a stretch
without own phrases the words alone decide. A pattern filled with other words keeps its words, but hardly an own phrase.

There may be any number of passages: their words, own phrases and instructions are found by aggregations, and they are searched in blocks of about ``block``, each
against all documents; only one block is ever on the driver and in the tasks.

Edge cases: null and empty texts hold nothing; case, punctuation, layout and markup tags are no part of
a word; a passage under ``least`` words is found when all of it is there, one word in eight aside; repeated documents
are each reported; a passage that occurs twice in a document gives two spans and one leak; documents of any
length are indexed whole; other columns are ignored; a passage whose id comes twice is each of its texts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.fmindex import FMIndex
from runweave.session import cut

_WORD = re.compile(r"[^\W_]+")
_TAGGED = re.compile(r"<[^<>]{1,80}>|[^\W_]+")
_END = re.compile(r"(?<=[.!?:;])\s+")


def words(text: str) -> list[str]:
    low = text.lower()
    if "<" in low:
        return [w for w in _TAGGED.findall(low) if w[0] != "<"]
    return _WORD.findall(low)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Characters of each word of ``words(text)``, in the text as it stands (lower case may change the length; then of the lower text)."""
    return [m.span() for m in _TAGGED.finditer(text.lower()) if m.group()[0] != "<"]


def _rest(text: str) -> tuple[str | None, str]:
    """The first sentence as words (None if there is no other), and what follows it."""
    p = _END.split(text.strip(), maxsplit=1)
    return (" ".join(words(p[0])), p[1]) if len(p) == 2 else (None, "")


def prepared(items: DataFrame, shared: int = 3) -> DataFrame:
    """item_id, words, own (whether the phrase of three words at each place is in two passages at most), without first sentences that begin
    at least ``shared`` passages."""
    first = F.udf(_rest, "struct<sentence:string,rest:string>")
    rows = cut(items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text", F.monotonically_increasing_id().alias("n")))
    while True:
        split = cut(rows.select("item_id", "n", "text", first("text").alias("f")).select("item_id", "n", "text", "f.sentence", "f.rest"))
        often = cut(split.where("sentence IS NOT NULL").groupBy("sentence").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= shared).select("sentence", F.lit(True).alias("o")))
        if not often.count():
            break
        rows = split.join(often, "sentence", "left").select("item_id", "n", F.when(F.col("o"), F.col("rest")).otherwise(F.col("text")).alias("text"))
    listed = cut(rows.select("item_id", "n", F.udf(words, "array<string>")("text").alias("words")).where("size(words) > 0"))
    w = F.col("words")
    phrases = F.transform(F.sequence(F.lit(1), F.size(w) - OWN + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, OWN), " ")))
    each = listed.where(F.size(w) >= OWN).select("n", F.posexplode(phrases).alias("at", "h"))
    own = each.join(each.dropDuplicates(["n", "h"]).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c <= 2"), "h")
    return listed.join(own.groupBy("n").agg(F.collect_list("at").alias("own")), "n", "left").select("item_id", "words", F.coalesce("own", F.array().cast("array<int>")).alias("own"))


#: Words of the phrases that tell a passage from others on the same pattern.
OWN = 3


class Passages:
    """A block of passages as symbols, and their phrases. 0 ends a text, 1 parts stretches, words begin at 2."""

    def __init__(self, rows: list[tuple[int, list[str], list[int]]], seed: int, least: int) -> None:
        self.seed, self.least = seed, least
        rows = sorted(rows)
        self.ids = [r[0] for r in rows]
        self.vocabulary = {w: k + 2 for k, w in enumerate(sorted({w for _, ws, _ in rows for w in ws}))}
        self.symbols = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws, _ in rows]
        self.own = []
        for s, (_, _, places) in zip(self.symbols, rows):
            self.own.append(np.zeros(len(s), bool))
            self.own[-1][places] = True
        places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, s in enumerate(self.symbols):
            for p in range(len(s) - seed + 1):
                places[tuple(s[p : p + seed].tolist())].append((k, p))
        self.phrases = np.array(list(places), np.int64).reshape(-1, seed)
        flat = [x for v in places.values() for x in v]
        self.item = np.array([k for k, _ in flat], np.int64)
        self.offset = np.array([p for _, p in flat], np.int64)
        self.begin = np.concatenate([[0], np.cumsum([len(v) for v in places.values()])]).astype(np.int64)

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """A number for the phrase of ``OWN`` words at each place."""
        out = np.zeros(max(0, len(symbols) - OWN + 1), np.int64)
        for k in range(OWN):
            out = out * (len(self.vocabulary) + 2) + symbols[k : len(symbols) - OWN + 1 + k]
        return out

    def belongs(self, k: int, begin: int, end: int, window: np.ndarray, matches: int) -> bool:
        """Whether the words from begin to end of passage k are that passage's and no mere pattern, as far as ``window`` has them."""
        held = self.symbols[k][begin:end]
        own = self.codes(held)[self.own[k][begin : max(begin, end - OWN + 1)]]
        if not len(own):
            return True
        share = matches / max(len(held), len(window))
        return np.isin(own, self.codes(window)).mean() >= 0.65 - 2 * (min(share, 1) - 0.75)

    def hits_needed(self, k: int) -> int:
        n = min(self.least, len(self.symbols[k]))
        return max(1, n - self.seed + 1 - self.seed * -(-n // 8))


def align(doc: list[int], item: list[int], low: int, high: int, least: float) -> list[tuple[int, int, int, int, int]]:
    """Local alignments on the diagonals (doc - item) from low to high: match 1, any change -1, so that
    a change near an end does not cut the end off. Of each place where one begins, the best that
    is ``least`` words of the passage long and has three of four of them. Gives doc begin and end,
    item begin and end, and matches; the rows are words of the passage."""
    best: dict[tuple[int, int], tuple] = {}
    n = len(doc)
    # score, doc begin, item begin, matches at each place of the row before
    last: dict[int, tuple] = {}
    for q, w in enumerate(item):
        row: dict[int, tuple] = {}
        for p in range(max(0, q + low), min(n, q + high + 1)):
            hit = doc[p] == w
            d = last.get(p - 1)
            if hit:
                cell = (d[0] + 1, d[1], d[2], d[3] + 1) if d else (1, p, q, 1)
            else:
                cell = (d[0] - 1, d[1], d[2], d[3]) if d and d[0] > 0 else None
                u, v = last.get(p), row.get(p - 1)
                if u and u[0] > 0 and (cell is None or u[0] - 1 > cell[0]):
                    cell = (u[0] - 1, u[1], u[2], u[3])
                if v and v[0] > 0 and (cell is None or v[0] - 1 > cell[0]):
                    cell = (v[0] - 1, v[1], v[2], v[3])
            if cell:
                row[p] = cell
                length = q + 1 - cell[2]
                if hit and length >= least and cell[3] >= 0.75 * length:
                    at = cell[1:3]
                    if at not in best or cell[0] >= best[at][0]:
                        best[at] = (cell[0], p + 1, q + 1, cell[3])
        last = row
    return [(p, e, q, f, k) for (p, q), (_, e, f, k) in best.items()]


class Shard:
    """Documents of one index."""

    def __init__(self, passages: Passages) -> None:
        self.p = passages
        self.docs: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        w = words(text) if text else []
        self.docs.append(np.fromiter(map(self.p.vocabulary.get, w, repeat(1)), np.int64, len(w)))
        self.size += len(w)

    def _text(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indexed symbols, and of each its document and word."""
        sizes = np.array([len(d) for d in self.docs])
        flat = np.concatenate([*self.docs, np.empty(0, np.int64)])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        known = flat > 1
        begin = known & np.concatenate([[True], ~known[:-1] | (doc[1:] != doc[:-1])]) if len(flat) else known
        run = np.cumsum(begin) - 1
        length = np.bincount(run[known], minlength=int(begin.sum()) + 1) if len(flat) else np.empty(0, int)
        keep = np.flatnonzero(known & (length[np.maximum(run, 0)] >= self.p.seed)) if len(flat) else np.empty(0, np.int64)
        if not keep.size:
            return np.empty(0, np.int64), keep, keep
        # A separator after every stretch, and the end.
        breaks = np.concatenate([run[keep][1:] != run[keep][:-1], [True]])
        at = np.arange(len(keep)) + np.concatenate([[0], np.cumsum(breaks)[:-1]])
        text = np.ones(int(at[-1]) + 3, np.int64)
        text[at] = flat[keep]
        text[-1] = 0
        d, p = np.full(len(text), -1, np.int64), np.zeros(len(text), np.int64)
        d[at], p[at] = doc[keep], pos[keep]
        return text, d, p

    def leaks(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, passage, first word, word after the last, matches) of each span, merged."""
        p = self.p
        if not len(p.phrases):
            return
        text, text_doc, text_pos = self._text()
        if not len(text):
            return
        index = FMIndex(text)
        phrase, at = index.locate(*index.search(p.phrases))
        del index
        # One row for each occurrence and each place of its phrase in a passage.
        n = p.begin[phrase + 1] - p.begin[phrase]
        row = np.repeat(np.arange(len(phrase)), n)
        place = np.repeat(p.begin[phrase] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        doc, word, item, off = text_doc[at[row]], text_pos[at[row]], p.item[place], p.offset[place]
        pair = doc * len(p.ids) + item
        order = np.lexsort((word, pair))
        pair, word, off = pair[order], word[order], off[order]
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
        ends = np.append(edge[1:], len(pair))
        need = np.array([p.hits_needed(k) for k in range(len(p.ids))])
        for a, b in zip(*(x[ends - edge >= need[pair[edge] % len(p.ids)]].tolist() for x in (edge, ends))):
            d, k = divmod(int(pair[a]), len(p.ids))
            yield from self._verify(d, k, word[a:b], off[a:b], int(need[k]))

    def _verify(self, d: int, k: int, word: np.ndarray, off: np.ndarray, need: int) -> Iterator[tuple[int, int, int, int, int]]:
        p = self.p
        item = p.symbols[k]
        m = len(item)
        slack = 4 + m // 8
        # Chains of hits on near diagonals, of any length: windows of a passage's length are slid over a chain.
        diagonal = word - off
        order = np.argsort(diagonal, kind="stable")
        diagonal, word = diagonal[order], word[order]
        cuts = np.flatnonzero(np.diff(diagonal) > slack) + 1
        spans = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(diagonal)]):
            if hi - lo < need:
                continue
            begin, end = int(diagonal[lo]), int(diagonal[hi - 1])
            for base in range(begin, end + 1, m):
                upto = min(base + m, end)
                a, b = np.searchsorted(diagonal[lo:hi], (base - slack, upto + slack + 1))
                if b - a < need:
                    continue
                start = max(0, base - slack)
                window = self.docs[d][start : upto + m + slack]
                for x in self._spans(window, k, base - 3 * slack - start, upto + slack - start, both=upto > base + slack):
                    spans.append((start + x[0], start + x[1], x[4]))
        merged: list[list[int]] = []
        for a, b, n in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1], merged[-1][2] = max(b, merged[-1][1]), max(n, merged[-1][2])
            else:
                merged.append([a, b, n])
        for a, b, n in merged:
            yield d, k, a, b, n

    def _spans(self, window: np.ndarray, k: int, low: int, high: int, both: bool) -> Iterator[tuple[int, int, int, int, int]]:
        """Alignments that hold enough of a passage. Where several stretches may lie in the window, it is also
        aligned from its end, as a stretch may have been joined to something before it that spoils it."""
        item = self.p.symbols[k]
        p, n, m = self.p, len(window), len(item)
        least = 0.9 * min(p.least, m)
        found = set(align(window.tolist(), item.tolist(), low, high, least))
        if both:
            back = align(window[::-1].tolist(), item[::-1].tolist(), n - m - high, n - m - low, least)
            found |= {(n - e, n - a, m - f, m - q, same) for a, e, q, f, same in back}
        for x in found:
            if p.belongs(k, x[2], x[3], window[x[0] : x[1]], x[4]):
                yield x


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, *, seed: int = 4, least: int = 20, shard_words: int = 3_000_000, block: int = 10_000) -> DataFrame:
    """docs against items (item_id, text). Gives id, item_id, first_word, last_word, begin, end (characters),
    matched (words) of every removal span."""
    passages = cut(prepared(items))
    blocks = max(1, -(-passages.count() // block))
    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in passages.where(F.pmod(F.xxhash64("item_id", F.size("words")), F.lit(blocks)) == b).collect()]
        found = _block_leaks(docs, key, text, Passages(rows, seed, least), shard_words)
        out = found if out is None else out.unionByName(found)
    return out


def _block_leaks(docs: DataFrame, key: str, text: str, passages: Passages, shard_words: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    ids = passages.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, texts = Shard(passages), [], []

        def flush() -> Iterator[pa.RecordBatch]:
            out = list(shard.leaks())
            if not out:
                return
            rows = []
            spans: dict[int, list] = {}
            for d, k, a, b, n in out:
                if d not in spans:
                    spans = {d: word_spans(texts[d])}
                s = spans[d]
                rows.append((keys[d], ids[k], a, b - 1, s[a][0], s[b - 1][1], n))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:])], _NAMES)

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard.add(t)
                keys.append(i)
                texts.append(t)
                if shard.size >= shard_words:
                    yield from flush()
                    shard, keys, texts = Shard(passages), [], []
        if keys:
            yield from flush()

    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    return source.mapInArrow(run, f"id {kind}, item_id bigint, first_word bigint, last_word bigint, begin bigint, end bigint, matched bigint")


_NAMES = ["id", "item_id", "first_word", "last_word", "begin", "end", "matched"]
