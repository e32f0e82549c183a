"""Repeated consecutive events: associative run summaries.

A sequence is cut into blocks of its order. Within a block, neighbouring runs of the same
event are joined; the summary of a block is its list of runs, of which only the first and the
last can still grow. Joining two summaries joins those edges, which is associative, so edges
are joined over blocks of ``fan`` blocks, level by level, until no sequence has more than ``fan`` blocks
left, which the last level takes together. Runs inside a block are final at once and are not sent on.

A block is a range of at most ``width`` neighbouring positions, so a sequence that makes up a third of
all rows is spread over as many tasks as it has blocks. The rows are moved once, by sequence and block, and sorted there;
copies of a position are removed in that order.

Neighbours are the same event if both fields agree in letters and digits after look-alike
characters are made plain, or differ by ``slips`` slips of typing at most (none in names under ``short[0]`` letters, one under ``short[1]``), and the numbers and
version words of the title agree.

Edge cases: rows without a sequence or position are in no sequence; an event is no match
if it is null or has two empty fields (null counts as empty), and neither ends a run nor is
in one; one empty field is compared as it is; of several rows at a position the one received
last counts, then the greater by value; equal neighbours at any distance in time are one run;
an empty table gives no rows; very long texts are compared in time linear in their length,
as only ``slips`` diagonals are looked at; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.names import key, marks, within
from runweave.llm.plainform import plain_column
from runweave.session import cut

SCHEMA = "seq string, block bigint, pos bigint, edge boolean, first_ts bigint, last_ts bigint, n bigint, artist string, title string, first_artist string, first_title string, last_artist string, last_title string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Same:
    """Whether two (artist, title) are one event; remembers what it worked out for recent ones."""

    def __init__(self, slips: int, short: tuple[int, int] = (4, 7)) -> None:
        """short: names under so many letters bear no slip, and one at most."""
        self.slips, self.short, self.known = slips, short, {}

    def _of(self, event: tuple[str, str]) -> tuple:
        if (got := self.known.get(event)) is None:
            if len(self.known) > 20_000:
                self.known.clear()
            artist, title = event
            if not (artist.isascii() and title.isascii()):
                artist, title = plain_column(pa.array([artist, title], pa.string()))[0].to_pylist()
            got = self.known[event] = (key(artist), key(title), marks(title))
        return got

    def _allowed(self, v: str, w: str) -> int:
        n = max(len(v), len(w))
        return 0 if n < self.short[0] else min(self.slips, 1) if n < self.short[1] else self.slips

    def __call__(self, a: tuple[str, str], b: tuple[str, str]) -> bool:
        if a == b:
            return True
        x, y = self._of(a), self._of(b)
        if x[:2] == y[:2]:
            return True
        only, other = set(x[2][1]) - set(y[2][1]), set(y[2][1]) - set(x[2][1])
        return x[2][0] == y[2][0] and not (only and other) and all(within(v, w, self._allowed(v, w)) for v, w in zip(x[:2], y[:2]))


def _encode(batches: Iterator[pa.RecordBatch | list], same: Same, edges: bool, whole: bool) -> Iterator[pa.RecordBatch]:
    """Joins neighbouring runs of each (seq, block); rows come sorted by seq, block, pos.

    Of a block the runs are held until its end is known; where blocks are whole sequences, nothing is held.

    edges: the rows are first (even pos) and last (odd pos) runs of blocks; a last run never
    joins the first one of its own block, as other runs lie between or they differ."""
    group, done, run = None, [], None
    out: list[list] = []

    def close() -> None:
        nonlocal run
        if run:
            (out if whole else done).append(run)
        run = None

    def flush() -> list[list]:
        if done:
            done[0][3] = done[-1][3] = True
        for i, r in enumerate(done):
            r[2] = i
        return done

    for b in batches:
        cols = b if isinstance(b, list) else b.columns
        m = len(cols[0])
        if not m:
            continue
        seqs = cols[0].dictionary_encode()
        seq_id, seq = seqs.indices.to_numpy(), seqs.dictionary.to_pylist()
        block, first, last, n = (cols[i].to_numpy() for i in (1, 4, 5, 6))
        made: dict[int, tuple] = {}
        for c in cols[7:13]:  # the same column under several names is encoded once
            if id(c) not in made:
                d = c.dictionary_encode()
                made[id(c)] = (d.indices.to_numpy(), d.dictionary.to_pylist())
        (ia, wa), (it, wt), (ja, va), (jt, vt), (ka, ua), (kt, ut) = (made[id(c)] for c in cols[7:13])
        apart = (cols[2].to_numpy() % 2 == 1) if edges else np.zeros(m, bool)
        plain = np.ones(m, bool) if cols[9] is cols[11] else pc.and_(pc.equal(cols[9], cols[11]), pc.equal(cols[10], cols[12])).to_numpy(zero_copy_only=False)
        fresh = np.ones(m, bool)
        fresh[1:] = (seq_id[1:] != seq_id[:-1]) | (block[1:] != block[:-1]) | (ja[1:] != ja[:-1]) | (jt[1:] != jt[:-1]) | ~plain[1:] | ~plain[:-1] | apart[1:]
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], m) - 1
        sums = np.add.reduceat(n, heads)
        for h, t, total in zip(heads.tolist(), tails.tolist(), sums.tolist()):
            g = (seq[seq_id[h]], int(block[h]))
            if g != group:
                close()
                out += flush()
                done, group = [], g
            if len(out) > 5000:
                yield _batch(out)
                out.clear()
            head, tail = (va[ja[h]], vt[jt[h]]), (ua[ka[t]], ut[kt[t]])
            if run and not apart[h] and same((run[11], run[12]), head):
                run[5], run[6], run[11], run[12] = int(last[t]), run[6] + total, *tail
            else:
                close()
                run = [g[0], g[1], 0, False, int(first[h]), int(last[t]), total, wa[ia[h]], wt[it[h]], *head, *tail]
    close()
    out += flush()
    if out:
        yield _batch(out)


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()] + [pa.string()] * 6


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], NAMES)


def _level(rows: DataFrame, slips: tuple, edges: bool, whole: bool) -> DataFrame:
    """The runs of each (seq, block), of events or of edges. Rows are moved once; of several events at a position the one
    received last counts, which the order that the runs need tells."""
    laid = rows.repartition("seq", "block")
    if not edges:
        last = Window.partitionBy("seq", "block", "pos").orderBy(*[F.col(c).desc_nulls_last() for c in ("received", "ts", "artist", "title")])
        laid = laid.withColumn("rn", F.row_number().over(last)).where("rn = 1").select("seq", "block", "pos", "ts", F.coalesce("artist", F.lit("")).alias("a"), F.coalesce("title", F.lit("")).alias("t")).where("a <> '' OR t <> ''")
    ordered = laid.sortWithinPartitions("seq", "block", "pos")
    return ordered.mapInArrow(lambda it: _encode(it if edges else map(_single, it), Same(*slips), edges, whole), SCHEMA)


def _single(b: pa.RecordBatch) -> list:
    """Events as runs of one; the columns are shared, not copied."""
    seq, block, pos, ts, a, t = b.columns
    n = b.num_rows
    return [seq, block, pos, None, ts, ts, pa.array(np.ones(n, np.int64)), a, t, a, t, a, t]


def runs(events: DataFrame, *, width: int = 4096, slips: int = 2, short: tuple[int, int] = (4, 7), fan: int = 1024) -> DataFrame:
    """``events``: seq, idx (position), ts, artist, title, received. Gives seq, first_ts, last_ts, n, artist, title
    (of the run's first event) of every longest run, those of one event too. ``fan`` is 2 at least."""
    if fan < 2:
        raise ValueError("fan is 2 at least")
    rows = events.where("seq IS NOT NULL AND idx IS NOT NULL AND ts IS NOT NULL").select(
        F.col("seq").cast("string").alias("seq"), F.floor(F.col("idx") / width).cast("bigint").alias("block"), F.col("idx").cast("bigint").alias("pos"), F.col("ts").cast("bigint").alias("ts"), "artist", "title", "received"
    )
    state = cut(_level(rows, (slips, short), False, False))
    kept, whole = state.where("NOT edge"), False
    while not whole:
        # The edges of neighbouring blocks, in the order of blocks, are one block of the next level.
        state = state.where("edge").withColumn("pos", F.col("block") * 2 + F.when(F.col("pos") > 0, 1).otherwise(0))
        blocks = state.groupBy("seq").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
        whole = blocks <= fan
        state = state.withColumn("block", F.lit(0).cast("bigint") if whole else F.floor(F.col("block") / fan).cast("bigint"))
        state = cut(_level(state, (slips, short), True, whole))
        kept = kept.unionByName(state if whole else state.where("NOT edge"))
    return kept.select("seq", "first_ts", "last_ts", "n", "artist", "title")
