import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from runweave.llm.pairs import block_pairs, pairs, plain, scored


def brute(baskets, least):
    n, both = Counter(), Counter()
    for items in baskets.values():
        s = sorted({i for i in items if i})
        n.update(s)
        both.update(combinations(s, 2))
    return {(a, b, n[a], n[b], k) for (a, b), k in both.items() if k >= least}


@pytest.mark.parametrize(("least", "block"), [(1, 256), (3, 2), (3, 256)])
def test_against_brute_force(spark, least, block):
    rnd = random.Random(5)
    baskets = {f"b{i}": [rnd.choice(["hot", "a", "b", "c", "d", "e", "é", None, ""]) for _ in range(rnd.randrange(0, 12))] for i in range(80)}
    rows = [(b, i, "extra", 7) for b, items in baskets.items() for i in items] + [(None, "a", "x", 1), (None, "b", "x", 1)]
    df = spark.createDataFrame(rows + rows[:50], "basket string, item string, w string, n_i int")
    got = {(r.item_a, r.item_b, r.n_a, r.n_b, r.n_ab) for r in pairs(df, min_count=least, block=block).collect()}
    assert got == brute(baskets, least)


def test_long_basket_and_empty(spark):
    rows = [("one", f"i{k:05d}") for k in range(700)]
    df = spark.createDataFrame(rows, "basket string, item string")
    assert pairs(df, block=64).count() == 700 * 699 // 2
    assert pairs(df.limit(0)).count() == 0
    assert pairs(spark.createDataFrame([("a", "x" * 300_000), ("a", "y")], "basket string, item string")).count() == 1


def test_scores(spark):
    df = spark.createDataFrame([("a", "b", 2, 4, 2), ("a", "c", 4, 4, 2)], "item_a string, item_b string, n_a int, n_b int, n_ab int")
    got = [(r.lift, r.conviction) for r in scored(df, F.lit(8)).collect()]
    assert got == [(2.0, None), (1.0, 1.0)]


def test_plain(spark):
    assert [r[0] for r in spark.createDataFrame([("  A\t b ",), (None,), ("",)], "v string").select(plain(F.col("v"))).collect()] == ["a b", None, ""]


def test_long_baskets_are_spread(spark):
    rows = [(b, k) for b in ("one", "same") for k in range(700)] + [("short", k) for k in range(5)]
    df = spark.createDataFrame(rows, "basket string, i bigint")
    out = block_pairs(df, 64)
    assert out.rdd.getNumPartitions() > 1 and sum(n > 0 for n in out.rdd.glom().map(len).collect()) > 1
    got = [(r.w, r.x, r.y) for r in out.collect()]
    assert max(len(x) for _, x, _ in got) < 2 * 64
    each = Counter()
    for w, x, y in got:
        each.update({tuple(sorted(p)): w for p in (combinations(x, 2) if y is None else ((a, b) for a in x for b in y))})
    assert each == Counter({(a, b): 2 + (b < 5) for a, b in combinations(range(700), 2)})
    assert len(got) == 11 * 12 // 2 + 1
