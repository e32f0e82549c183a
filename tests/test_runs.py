import random

import pytest
from pyspark.sql import functions as F

from runweave.operators.runs import collapse, latest, numbered

SCHEMA = "s string, i bigint, k string"


def scan(keys):
    """The state machine in plain Python: (position, key or None for a gap)."""
    counts = {}
    for k in keys:
        counts[k] = counts.get(k, 0) + 1
    out, last, gap = [], None, None
    for i, k in enumerate(keys):
        if k is None or counts[k] == 1:
            if last is not None and gap is None:
                gap = i
        elif k != last:
            if gap is not None:
                out.append((gap, None))
            out.append((i, k))
            last, gap = k, None
    if gap is not None:
        out.append((gap, None))
    return out


def run(spark, sets, width):
    rows = [(s, i, k) for s, keys in sets.items() for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in collapse(df, "s", "i", F.col("k"), ["k"], width=width).collect():
        got.setdefault(r["s"], []).append((r["i"], r["k"] if r["matched"] else None))
    return {s: sorted(v, key=lambda x: x[0]) for s, v in got.items()}


CASES = {
    "singleton": ("RRX", [(0, "R"), (2, None)]),
    "collapse": ("TTT", [(0, "T")]),
    "distinct": ("AABB", [(0, "A"), (2, "B")]),
    "gap, same key again": ("TT..TT", [(0, "T"), (2, None)]),
    "gap, another key": ("AA..BB", [(0, "A"), (2, None), (4, "B")]),
    "leading gap": (".AA", [(1, "A")]),
    "repeat apart is no singleton": ("ABBA", [(0, "A"), (1, "B"), (3, "A")]),
    "early gap stays": ("AA.AABB", [(0, "A"), (2, None), (5, "B")]),
}


def test_cases(spark):
    sets = {n: [None if c == "." else c for c in text] for n, (text, _) in CASES.items()}
    got = run(spark, sets, 4096)
    assert got == {n: want for n, (_, want) in CASES.items()}


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_random_sets_in_chunks(spark, width):
    rnd = random.Random(7)
    sets = {f"s{n}": [rnd.choice(["a", "b", "c", None, f"x{rnd.randrange(9)}"]) for _ in range(rnd.randrange(1, 40))] for n in range(60)}
    want = {s: scan(k) for s, k in sets.items()}
    assert run(spark, sets, width) == {s: sorted(v) for s, v in want.items() if v}


def test_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1, "a"), ("s", None, "a")], SCHEMA)
    assert collapse(df, "s", "i", F.col("k"), ["k"]).count() == 0
    assert collapse(df.limit(0), "s", "i", F.col("k"), ["k"]).count() == 0


def test_latest_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "k string, at int, v string")
    assert {(r.k, r.v) for r in latest(df, ["k"], ["at"], ["v"]).collect()} == {("a", "y"), ("b", "z")}


@pytest.mark.parametrize("width", [1, 5, 4096])
def test_numbered(spark, width):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), i, t, rnd.randrange(9)) for t, i in enumerate(rnd.sample(range(200), 60))] + [("a", 7, 900, 1), (None, 1, 1, 1), ("a", None, 1, 1)]
    df = spark.createDataFrame(rows, "g string, i int, t int, v int")
    want = []
    for g in "ab":
        mine = sorted((i, t, v) for x, i, t, v in rows if x == g and i is not None)
        want += [(g, i, t, v, k + 1, len(mine), sum(x[2] for x in mine[:k])) for k, (i, t, v) in enumerate(mine)]
    assert sorted(map(tuple, numbered(df, "g", ["i", "t"], amount="v", width=width).collect())) == sorted(want)
    assert numbered(df.limit(0), "g", ["i", "t"]).count() == 0
