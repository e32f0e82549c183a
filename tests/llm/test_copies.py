import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from runweave.llm.copies import _least_rotation_of, copies, least_rotation, terminals

SCHEMA = "id bigint, a string, t string, g string, ts int, n int, key string"


def brute(rows):
    def key(x):
        return "".join(c for c in (x or "").lower() if c.isalnum())

    held = [(i, {(o, g, ts) for o in (key(a) + key(t), key(t) + key(a))}) for i, a, t, g, ts in rows if i is not None and key(a) + key(t)]
    group = list(range(len(held)))
    while True:
        first = {}
        for (_, orders), g in zip(held, group):
            for o in orders:
                first[o] = min(first.get(o, g), g)
        new = [min(g, *(first[o] for o in orders)) for (_, orders), g in zip(held, group)]
        if new == group:
            break
        group = new
    members = defaultdict(list)
    for (i, _), g in zip(held, group):
        members[g].append(i)
    return sorted((i, min(v), len(v)) for v in members.values() for i in v)


@pytest.mark.parametrize("capacity", [3, 40, 100_000])
def test_against_brute_force(spark, capacity):
    rnd = random.Random(2)
    ways = [("Ann Lee", "Song No. 1"), ("ann  lee", "SONG-no 1"), ("Song No. 1", "Ann Lee"), ("", "Ann Lee / Song No. 1"), ("Song No.1: Ann Lee", None), ("Ann Lee", "Song No. 2"), ("", ""), (None, "..."), ("É", "x"), ("é", "X"), ("AB", "CDE"), ("BC", "DEA"), ("CDE", "AB"), ("", "DEABC"), ("abcd", "e"), ("ana", "nas"), ("nas", "ana"), ("anan", "as"), ("aa", "a"), ("", "aaa")]
    rows = [(i, *rnd.choice(ways), rnd.choice(["s", "hot", "hot", "hot", None]), rnd.choice([0, 0, 30, None])) for i in range(400)] + [(None, "a", "b", "s", 0), (7, "Ann Lee", "Song No. 1", "s", 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert sorted(map(tuple, copies(df, "id", ["a", "t"], ["g", "ts"], capacity=capacity).collect())) == brute(rows)


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "ab" * 60_000, "c", "s", 0, 1, ""), (2, "c", "AB " * 60_000, "s", 0, 1, "")], SCHEMA)
    assert sorted(map(tuple, copies(df, "id", ["a", "t"], ["g", "ts"]).collect())) == [(1, 1, 2), (2, 1, 2)]
    assert copies(df.limit(0), "id", ["a", "t"], ["g", "ts"]).count() == 0


def test_group_columns_do_not_run_together(spark):
    df = spark.createDataFrame([(1, "x", "", "a", 1, 0, ""), (2, "x", "", None, 1, 0, ""), (3, "x", "", "a", None, 0, "")], SCHEMA)
    assert {r.n for r in copies(df, "id", ["a", "t"], ["g", "ts"]).collect()} == {1}


def test_rotation():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 12))) for _ in range(400)] + ["aaaa", "a", "abab"]
    n = np.array([len(t) for t in texts])
    m = np.zeros((len(texts), n.max()), np.uint32)
    for i, t in enumerate(texts):
        m[i, : len(t)] = [ord(c) for c in t]
    for t, k in zip(texts, least_rotation(m, n)):
        want = min(t[i:] + t[:i] for i in range(len(t)))
        assert t[k:] + t[:k] == want
        k = _least_rotation_of([ord(c) for c in t])
        assert t[k:] + t[:k] == want


def test_trie_tells_prefixes_apart():
    keys = [b"", b"a", b"abcdefgh", b"abcdefghi", b"abcdefghabcdefgh", b"abcdefg", b"a\0", b"abcdefgh\0"]
    ends = terminals(pa.array(keys * 2, pa.binary()), np.zeros(2 * len(keys), np.int64))
    assert len(set(ends)) == len(keys) and (ends[: len(keys)] == ends[len(keys) :]).all()
    apart = terminals(pa.array([b"abc", b"abc"], pa.binary()), np.array([0, 1]))
    assert apart[0] != apart[1]


def test_words_are_cut_at_fields_only(spark):
    rows = [(1, "AB", "CDE"), (2, "BC", "DEA"), (3, "ana", "nas"), (4, "nas", "ana"), (5, "", "CDE ab"), (6, "cde", "A B"), (7, "", "anasn a")]
    df = spark.createDataFrame([(i, a, t, "s", 0, 1, "") for i, a, t in rows], SCHEMA)
    got = {r.id: (r.keep_id, r.n) for r in copies(df, "id", ["a", "t"], ["g", "ts"]).collect()}
    assert got == {1: (1, 3), 5: (1, 3), 6: (1, 3), 2: (2, 1), 3: (3, 2), 4: (3, 2), 7: (7, 1)}


def test_recursion_over_the_whole_table(spark, data):
    """The real table at a capacity that needs further bytes and hot keys gives the same rows."""
    tracks = spark.read.parquet(f"{data}/tracks.parquet")
    want = sorted(map(tuple, copies(tracks, "track_id", ["artist", "title"], ["set_id", "ts"]).collect()))
    assert sorted(map(tuple, copies(tracks, "track_id", ["artist", "title"], ["set_id", "ts"], capacity=2).collect())) == want and len(want) > 500
