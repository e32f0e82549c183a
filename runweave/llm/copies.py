"""Duplicates hidden by formatting: canonical bytes, recursive radix partitioning, tries.

Two records of one group are copies if their texts have the same letters and digits in lower case, in one of the orders of the fields: the first before
the second, or the second before the first; a field left empty has one order only. So exchanged fields meet, and either of them meets
both written into one. A word cut elsewhere than at a border of fields makes no copy.

All orders of one record are rotations of one text, so the least rotation is the key that brings everything that may be copies into one place:
canonical bytes, then the group columns. In that place the records that share an order are joined, and those that follow from them.

Partitioning: the rows are counted by the first bytes of their keys. A bucket over ``capacity`` rows
is split by further bytes, twice as many each time, until each bucket fits or its key has ended.
A key that alone is over ``capacity`` cannot be split: its copies are counted and their least id is
found by aggregation with a map-side combine, and its rows are spread by salt. Every other bucket
fits into one task, which counts in tries whose edges are pieces of eight bytes and whose terminal
nodes hold the counters; the tries of many buckets are built level by level with array operations.

At most rows / capacity buckets are too large at any level, which bounds what is broadcast.

Edge cases: null fields count as empty; rows without any letter or digit, or with a null id, have
no copies and are left out; null group values are a value of their own; texts that are
canonically equivalent in Unicode are equal; texts of any length are handled; an id twice counts
twice; an empty table gives no rows; columns are addressed by position, so names cannot clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm.arrowtext import from_codes, string_buffers, take_rows, to_codes
from runweave.llm.plainform import TOP, _compose, _offsets, _row_of, tables
from runweave.session import cut, parallelism

LEVELS = (2, 4, 8, 16, 32, 64, 128, 256, 1024)
#: Texts over this many letters are rotated one by one.
LONG = 2048
#: Tables of prefixes up to this size are broadcast (at most 1 KB each, mostly under 50 bytes).
BROADCAST_ROWS = 20_000


@cache
def _folding() -> np.ndarray:
    """Lower case of letters and digits; 0 for everything else. Made by rule from the Unicode database."""
    t = np.zeros(TOP, np.uint32)
    for cp in range(0x30, 0x32400):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if unicodedata.category(c)[0] in "LN":
            low = c.lower()
            t[cp] = ord(low[0]) if unicodedata.category(low[0])[0] in "LN" else cp
    return t


def least_rotation(matrix: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where the first rotation in order begins, for each row of ``matrix`` with its ``n`` leading values."""
    rows = np.arange(len(n))
    i, j, k = np.zeros(len(n), np.int64), np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
    live = rows[n > 1]
    while live.size:
        m, a, b, c = n[live], i[live], j[live], k[live]
        x, y = matrix[live, (a + c) % m], matrix[live, (b + c) % m]
        same, more = x == y, x > y
        a = np.where(more, a + c + 1, a)
        b = np.where(~same & ~more, b + c + 1, b)
        c = np.where(same, c + 1, 0)
        hit = a == b
        a, b = a + (hit & more), b + (hit & ~more)
        i[live], j[live], k[live] = a, b, c
        live = live[(a < m) & (b < m) & (c < m)]
    return np.where(n > 1, np.minimum(i, j), 0)


def _least_rotation_of(text: list[int]) -> int:
    """The same for one long text, without a matrix."""
    n, i, j, k = len(text), 0, 1, 0
    while i < n and j < n and k < n:
        x, y = text[(i + k) % n], text[(j + k) % n]
        if x == y:
            k += 1
            continue
        if x > y:
            i += k + 1
        else:
            j += k + 1
        if i == j:
            j += 1
        k = 0
    return min(i, j)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits well spread over 64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _orders(codes: np.ndarray, at: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text as it is, and of the text with its first ``head`` letters behind the others."""
    size = np.diff(at)
    if not len(codes):
        return np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    pos = np.arange(at[-1]) - np.repeat(at[:-1], size)
    turned = (pos - np.repeat(head, size)) % np.repeat(np.maximum(size, 1), size)
    out = []
    for p in (pos, turned):
        with np.errstate(over="ignore"):
            v = _mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])
        with np.errstate(over="ignore"):
            out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def canonical(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points and offsets of the canonical text of each row, and hashes of its two orders: the fields as they stand, and
    the first one behind the others."""
    t, fold = tables(), _folding()
    n = len(columns[0])
    parts = []
    for col in columns:
        codes, at = to_codes(*string_buffers(col))
        rows = _row_of(at)
        if (codes >= 0x300).any():
            codes, rows = _compose(t, codes, rows)
        low = fold[codes]
        keep = low > 0
        parts.append((low[keep], rows[keep]))
    codes, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    codes = codes[np.argsort(rows, kind="stable")]
    at = _offsets(rows, n)
    size = np.diff(at)
    one, two = _orders(codes, at, np.bincount(parts[0][1], minlength=n))
    start = np.zeros(n, np.int64)
    order = np.argsort(size, kind="stable")
    lo = int(np.searchsorted(size[order], 2))
    while lo < n:
        # Rows of like length share a matrix of at most 4 M values.
        hi = lo + 1
        hi = min(n, lo + max(1, min(8192, 4_000_000 // int(size[order[min(n - 1, lo + 8191)]]))))
        pick = order[lo:hi]
        width = int(size[pick].max())
        if width > LONG:
            for r in pick.tolist():
                start[r] = _least_rotation_of(codes[at[r] : at[r + 1]].tolist())
            lo = hi
            continue
        flat, off = take_rows(codes, at, pick)
        matrix = np.zeros((len(pick), width), np.uint32)
        matrix[np.repeat(np.arange(len(pick)), np.diff(off)), np.arange(off[-1]) - np.repeat(off[:-1], np.diff(off))] = flat
        start[pick] = least_rotation(matrix, size[pick])
        lo = hi
    pos = np.arange(at[-1]) - np.repeat(at[:-1], size)
    turned = np.repeat(at[:-1], size) + (pos + np.repeat(start, size)) % np.repeat(np.maximum(size, 1), size)
    return codes[turned], at, one, two


STEP = 8


def terminals(keys: pa.Array, root: np.ndarray) -> np.ndarray:
    """The terminal node of each key in the trie of its root. Edges are pieces of eight bytes; the tries are built level by level: a level's
    nodes are the distinct pairs of parent and piece. A last piece is marked by its length, as it may be a prefix of another."""
    raw, at = string_buffers(keys)
    size = np.diff(at)
    node = root.astype(np.int64)
    out = np.full(len(size), -1, np.int64)
    live, depth, nodes = np.arange(len(size)), 0, 0
    while live.size:
        left = np.minimum(size[live] - depth, STEP)
        piece = np.zeros((len(live), STEP), np.uint8)
        for k in range(STEP):
            has = left > k
            piece[has, k] = raw[at[live[has]] + depth + k]
        value = piece.view(np.uint64).ravel()
        order = np.lexsort((left, value, node[live]))
        x, v, m = node[live][order], value[order], left[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (x[1:] != x[:-1]) | (v[1:] != v[:-1]) | (m[1:] != m[:-1])
        to = np.empty(len(order), np.int64)
        to[order] = np.cumsum(fresh) - 1 + nodes
        node[live] = to
        nodes += int(fresh.sum())
        ended = left < STEP
        out[live[ended]] = to[ended]
        live, depth = live[~ended], depth + STEP
    return out


def components(place: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A number for each row: rows of one place that share an order, directly or over others, have the same."""
    n = len(place)
    order = np.lexsort((np.concatenate([one, two]), np.concatenate([place, place])))
    p, o = np.concatenate([place, place])[order], np.concatenate([one, two])[order]
    fresh = np.ones(2 * n, bool)
    fresh[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
    text = np.empty(2 * n, np.int64)
    text[order] = np.cumsum(fresh) - 1
    a, b = text[:n], text[n:]
    label = np.arange(int(fresh.sum()))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label[a]
        label = new


def _keys(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        codes, at, one, two = canonical(b.columns[2 : 2 + fields])
        held = pa.array(np.flatnonzero(np.diff(at) > 0))
        text = from_codes(codes, at).cast(pa.binary())
        key = pc.binary_join_element_wise(text, b.column(1).cast(pa.binary()), pa.scalar(b"\0", pa.binary()))
        yield pa.RecordBatch.from_arrays([b.column(0).take(held), key.take(held), pa.array(one).take(held), pa.array(two).take(held)], ["id", "key", "one", "two"])


def _count(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Whole buckets at a time: rows come sorted by bucket."""

    def close(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        bucket = t["b"].combine_chunks().dictionary_encode().indices.to_numpy()
        i = t["id"].to_numpy()
        group = components(terminals(t["key"].combine_chunks(), bucket), t["one"].to_numpy(), t["two"].to_numpy())
        n = np.bincount(group)
        least = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(least, group, i)
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(least[group]), pa.array(n[group].astype(np.int64))], ["id", "keep_id", "n"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held)
            last = t["b"][-1]
            whole = size - pc.sum(pc.equal(t["b"], last)).as_py()
            if whole:
                yield close(t.slice(0, whole))
            held, size = t.slice(whole).to_batches(), size - whole
    if held:
        yield close(pa.Table.from_batches(held))


def _hot_groups(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of one key: its distinct pairs of orders, with counts."""
    g = pd.Series(components(np.zeros(len(frame), np.int64), frame["one"].to_numpy(), frame["two"].to_numpy()), index=frame.index)
    return pd.DataFrame({"key": frame["key"], "one": frame["one"], "two": frame["two"], "keep_id": frame["least"].groupby(g).transform("min"), "n": frame["c"].groupby(g).transform("sum")})


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def copies(df: DataFrame, id_col: str, fields: list[str], group: list[str], *, capacity: int = 100_000) -> DataFrame:
    """id, keep_id (least id of its copies), n (number of copies, itself included) of every row with a text."""
    tail = F.concat_ws("\0", *[F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("-")) for g in group])
    source = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("i"), tail.alias("t"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{k}") for k, f in enumerate(fields)])
    keyed = cut(source.mapInArrow(lambda it: _keys(it, len(fields)), "id bigint, key binary, one bigint, two bigint"))

    def cut_at(level: int) -> Column:
        return F.substring("key", 1, level)

    large: list[tuple[int, DataFrame, int]] = []
    rows = keyed
    for level in LEVELS:
        over = cut(rows.groupBy(cut_at(level).alias("p")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > capacity).select("p"))
        if not (m := over.count()):
            break
        large.append((level, over, m))
        rows = rows.withColumn("p", cut_at(level)).join(_maybe_broadcast(over, m), "p", "left_semi").drop("p")
    hot, m_hot = None, 0
    if large:
        hot = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > capacity).select("key"))
        m_hot = hot.count()
    spread = keyed
    if m_hot:
        spread = spread.join(_maybe_broadcast(hot.select("key"), m_hot), "key", "left_anti")
    bucket = cut_at(LEVELS[len(large)]) if len(large) < len(LEVELS) else F.col("key")
    for k, (level, over, m) in reversed(list(enumerate(large))):
        spread = spread.withColumn("p", cut_at(level)).join(_maybe_broadcast(over.withColumn(f"o{k}", F.lit(True)), m), "p", "left").drop("p")
        bucket = F.when(F.col(f"o{k}").isNull(), cut_at(level)).otherwise(bucket)
    parts = max(parallelism(df.sparkSession), 2 * keyed.count() // capacity)
    spread = spread.select("id", "key", "one", "two", bucket.alias("b")).repartition(parts, "b").sortWithinPartitions("b")
    out = spread.mapInArrow(_count, "id bigint, keep_id bigint, n bigint")
    if m_hot:
        # Of a key there are as many distinct pairs of orders as ways to cut its text, however many rows it has.
        ways = keyed.join(_maybe_broadcast(hot, m_hot), "key").groupBy("key", "one", "two").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("least"))
        groups = cut(ways.groupBy("key").applyInPandas(_hot_groups, "key binary, one bigint, two bigint, keep_id bigint, n bigint"))
        out = out.unionByName(keyed.join(_maybe_broadcast(groups, groups.count()), ["key", "one", "two"]).select("id", "keep_id", "n"))
    return out
