"""Filling fixed-capacity containers: bin completion by branch and bound.

Sizes are tokens of a public tokenizer whose folder is a parameter. Documents are spread by hash over
shards of about ``shard_items`` documents; a shard is packed by one task, of which only ids and
sizes are held, never texts. Containers of different shards are never joined, which leaves at
most about one loose container per shard.

Within a shard the packing is made by a search over containers for a given number of them, beginning with a lower
bound. A container is begun by the largest document at hand; its fillings are enumerated by growing waste,
those dominated by another one (a part of the filling can be replaced by one document that is no smaller and left out) are
passed over, and a branch ends where the waste so far, or the lower bound of the rest, exceeds what the number of
containers leaves. Where a container has no filling left, the one before takes its next one. The best-fit packing is the
incumbent: it bounds the search, and stands only where no search came to an end. ``made`` and ``proven`` say of each
container which of the two made it and whether its shard is known to need that many.

Edge cases: a document over the capacity is split into full containers and a rest that is packed
like any other; only such a document is split; null and empty texts have size 0 and are put into the
container that is first in its shard; equal sizes are taken in order of id; repeated ids are packed as rows of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"


@cache
def _encoding(folder: str, vocabulary: str):
    import tiktoken

    spec = importlib.util.spec_from_file_location("_tokenizer_files", os.path.join(folder, "__init__.py"))
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str, text: str, *, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, tokens of every row; texts go to Python in batches and only numbers come back."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(folder, vocabulary).encode_ordinary
        for b in batches:
            n = [len(encode(x)) if x else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "tokens"])

    return df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"id {kind}, tokens bigint")


class _Sizes:
    """A multiset of sizes; the set bits of an integer are the sizes at hand, so the largest one under a limit is one step."""

    def __init__(self, sizes: list[int]) -> None:
        self.count: dict[int, int] = defaultdict(int)
        self.bits, self.n, self.sum = 0, len(sizes), sum(sizes)
        for s in sizes:
            self.count[s] += 1
            self.bits |= 1 << s

    def largest(self, limit: int) -> int:
        """0 if none fits."""
        return (self.bits & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and self.bits & ((1 << (limit + 1)) - 2) else 0

    def take(self, s: int) -> None:
        self.count[s] -= 1
        self.n -= 1
        self.sum -= s
        if not self.count[s]:
            self.bits ^= 1 << s

    def put(self, s: int) -> None:
        if not self.count[s]:
            self.bits |= 1 << s
        self.count[s] += 1
        self.n += 1
        self.sum += s


class Spent(Exception):
    """The nodes of a search are used up."""


def dominated(filling: list[int], waste: int, others: int) -> bool:
    """Whether a size left out (the set bits of ``others``) can take the place of a part of the filling that is no larger than it. What
    was packed around the exchanged filling can then be packed around the other, so this one need not be tried."""
    none, one, more = 1, 0, 0  # sums of no, one, several members
    for s in filling:
        more |= (more << s) | (one << s)
        one |= 1 << s
    if more & others:
        return True
    if not waste:
        return False
    # Sums that grow by 1 to ``waste``.
    reach, done = (none | one | more) << 1, 1
    while done < waste:
        step = min(done, waste - done)
        reach |= reach << step
        done += step
    return bool(reach & others)


def fillings(at_hand: _Sizes, room: int, most: int, node: Callable[[], None]) -> Iterator[tuple[list[int], int]]:
    """(sizes, waste) of every undominated filling of ``room`` that wastes ``most`` at most, little waste first. What is yielded is
    taken out of ``at_hand`` until the next one is asked for."""
    path: list[int] = []

    def wastes(low: int, high: int) -> Iterator[int]:
        left = room
        if low <= left <= high and not dominated(path, left, at_hand.bits):
            yield left
        s = at_hand.largest(left - low)
        while True:
            # What can follow, at this size or under it, has to bring the waste to ``high``.
            if s > 0 and left - min(at_hand.sum, s * at_hand.n) <= high:
                node()
                at_hand.take(s)
                path.append(s)
                left -= s
                if left <= high and not dominated(path, left, at_hand.bits):
                    yield left
                s = at_hand.largest(min(left - low, s))
            elif path:
                s = path.pop()
                at_hand.put(s)
                left += s
                s = at_hand.largest(s - 1)
            else:
                return

    low = high = max(0, room - at_hand.sum)
    while low <= most:
        for waste in wastes(low, min(high, most)):
            yield list(path), waste
        low, high = high + 1, 2 * high + 1


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the places of ``sizes`` (descending) by container."""
    rooms: dict[int, list[int]] = defaultdict(list)
    bits, out = 0, []
    for i, s in enumerate(sizes):
        fit = bits >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            c = rooms[room].pop()
            if not rooms[room]:
                bits ^= 1 << room
        else:
            room, c = capacity, len(out)
            out.append([])
        out[c].append(i)
        if rest := room - s:
            rooms[rest].append(c)
            bits |= 1 << rest
    return out


def least_containers(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of containers: sizes over half the capacity stand apart, and what is over the
    room beside them needs containers of its own, looked at for every least size that counts."""
    if not len(sizes):
        return 0
    s = np.sort(np.asarray(sizes, np.int64))
    below = np.concatenate([[0], np.cumsum(s)])
    half = int(np.searchsorted(s, capacity / 2, side="right"))
    k = np.unique(np.append(s[:half], 0))
    first = np.searchsorted(s, k)  # sizes of k and more
    alone = np.searchsorted(s, capacity - k, side="right")  # sizes that no k fits beside
    alone = np.maximum(alone, half)
    beside = (alone - half) * capacity - (below[alone] - below[half])
    rest = np.maximum(0, below[half] - below[np.minimum(first, half)] - beside)
    return int((len(s) - half + -(-rest // capacity)).max())


def search(sizes: list[int], capacity: int, target: int, node: Callable[[], None]) -> list[list[int]] | None:
    """A packing of ``sizes`` into ``target`` containers, or None if there is none: each container is begun by the largest
    size at hand and completed by one of its fillings; where the waste so far, or the least number of containers for
    the rest, exceeds what the target leaves, the filling before is changed."""
    at_hand = _Sizes(sizes)

    def containers(allowed: int) -> Iterator[tuple[list[int], int]]:
        s = at_hand.largest(capacity)
        at_hand.take(s)
        for filling, waste in fillings(at_hand, capacity - s, allowed, node):
            yield [s, *filling], waste
        at_hand.put(s)

    allowed = [target * capacity - at_hand.sum]
    if allowed[0] < 0:
        return None
    if not at_hand.n:
        return []
    open_levels, out = [containers(allowed[0])], []
    while open_levels:
        del out[len(open_levels) - 1 :]
        del allowed[len(open_levels) :]
        step = next(open_levels[-1], None)
        if step is None:
            open_levels.pop()
            continue
        out.append(step[0])
        if not at_hand.n:
            return out
        if len(out) >= target:
            continue
        # The bound of the rest takes a pass over it, so a long rest is only looked at by its waste.
        if at_hand.n <= BOUNDED and least_containers(np.repeat(*_counted(at_hand)), capacity) > target - len(out):
            continue
        allowed.append(allowed[-1] - step[1])
        open_levels.append(containers(allowed[-1]))
    return None


#: Rests up to this many sizes are bounded at every node of the search.
BOUNDED = 200


def _counted(at_hand: _Sizes) -> tuple[np.ndarray, np.ndarray]:
    held = [(s, n) for s, n in at_hand.count.items() if n]
    return np.array([s for s, _ in held], np.int64), np.array([n for _, n in held], np.int64)


def pack(sizes: list[int], capacity: int, nodes: int = 100_000) -> tuple[list[list[int]], str, bool]:
    """Places of ``sizes`` (each from 1 to ``capacity``, descending) by container, what made them ('search' or 'best fit'), and
    whether fewer containers are known to be impossible.

    The number of containers that is looked for begins at the lower bound and grows by one where the search has shown that there is no such
    packing. A search that has used up its nodes (``nodes`` and 64 per size) leaves the question open: ``proven`` is then false, and the number grows by an eighth of
    what lies between it and the incumbent. The best-fit packing is the incumbent: it stands only where no search succeeded."""
    incumbent = best_fit(sizes, capacity)
    target, proven = least_containers(np.array(sizes, np.int64), capacity), True
    while target <= len(incumbent):
        left = nodes + 64 * len(sizes)

        def node() -> None:
            nonlocal left
            left -= 1
            if left < 0:
                raise Spent

        try:
            found = search(sizes, capacity, target, node)
            step = 1
        except Spent:
            found, proven, step = None, False, max(1, (len(incumbent) - target) // 8)
        if found is not None:
            places: dict[int, list[int]] = defaultdict(list)
            for i in range(len(sizes) - 1, -1, -1):
                places[sizes[i]].append(i)
            return [[places[s].pop() for s in c] for c in found], "search", proven
        target += step
    return incumbent, "best fit", proven


SCHEMA = "container bigint, id {kind}, piece bigint, pieces bigint, first_token bigint, tokens bigint, at bigint, made string, proven boolean"
_NAMES = ["container", "id", "piece", "pieces", "first_token", "tokens", "at", "made", "proven"]


def _pack_shard(shard: int, ids: pa.Array, tokens: np.ndarray, capacity: int, nodes: int) -> Iterator[pa.RecordBatch]:
    full, rest = tokens // capacity, tokens % capacity
    pieces = np.maximum(1, full + (rest > 0))
    item = np.flatnonzero(rest > 0)
    item = item[np.argsort(-rest[item], kind="stable")]
    bins, made, proven = pack(rest[item].tolist(), capacity, nodes)
    packed = len(bins)
    rows: list[tuple] = []
    c = 0
    for places in bins:
        at = 0
        for p in places:
            i = int(item[p])
            rows.append((c, i, int(full[i]), int(rest[i]), at))
            at += int(rest[i])
        c += 1
    for i in np.flatnonzero(full).tolist():
        for k in range(int(full[i])):
            rows.append((c, i, k, capacity, 0))
            c += 1
    rows += [(0, i, 0, 0, 0) for i in np.flatnonzero(tokens == 0).tolist()]
    if not rows:
        return
    col = np.array(rows, np.int64)
    for lo in range(0, len(col), 50_000):
        x = col[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[:, 0] + (shard << 32)), ids.take(pa.array(x[:, 1])), pa.array(x[:, 2] + 1), pa.array(pieces[x[:, 1]]), pa.array(x[:, 2] * capacity), pa.array(x[:, 3]), pa.array(x[:, 4])]
            + [pa.array(np.where(x[:, 0] < packed, made, "split")), pa.array(np.full(len(x), proven))],
            _NAMES,
        )


def fill(sized: DataFrame, capacity: int, *, shard_items: int = 50_000, nodes: int = 100_000) -> DataFrame:
    """sized: id, tokens. Gives container, id, piece (from 1), pieces, first_token (of the piece in its
    document), tokens, at (where it begins in the container), made ('search', 'best fit', or 'split' for a full piece), proven."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    from runweave.session import cut

    kind = sized.schema["id"].dataType.simpleString()
    sized = cut(sized.select("id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")))
    shards = max(1, -(-sized.count() // shard_items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        if not t.num_rows:
            return
        by_shard = t["shard"].to_numpy()
        for s in np.unique(by_shard):
            part = t.filter(pa.array(by_shard == s)).combine_chunks()
            yield from _pack_shard(int(s), part["id"].combine_chunks(), part["tokens"].to_numpy(), capacity, nodes)

    # The row's place in the settled table is part of the hash, so that rows with one id, or none, are spread too.
    spread = sized.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards))).repartition(max(shards, 1), "shard").sortWithinPartitions("shard", "id")
    return spread.mapInArrow(run, SCHEMA.format(kind=kind))
