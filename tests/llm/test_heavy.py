import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runweave.llm.heavy import by_share, top_k

SCHEMA = "item string, h string, field string, n bigint"


def table(spark, values):
    return spark.createDataFrame([(v, "x", "y", 1) for v in values], SCHEMA)


def skewed():
    rnd = random.Random(3)
    return ["hot"] * 900 + ["warm"] * 300 + [f"v{int(rnd.paretovariate(0.7))}" for _ in range(1500)] + [None, "", "", None]


@pytest.mark.parametrize("bits", [(1, 3, 64), (14, 28, 64), (64,)])
def test_against_counter(spark, bits):
    values = skewed()
    count = Counter(v for v in values if v)
    df = table(spark, values)
    got = {(r.item, r.n, r["rank"]) for r in top_k(df, {"f": F.col("item")}, 7, bits=bits).collect()}
    want = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:7]
    assert got == {(v, n, k + 1) for k, (v, n) in enumerate(want)}
    total = sum(count.values())
    share = {(r.item, r.n, r.total) for r in by_share(df, {"f": F.col("item")}, 1, 100, bits=bits).collect()}
    assert share == {(v, n, total) for v, n in count.items() if n * 100 >= total}


def test_ties_fewer_values_than_k_and_two_fields(spark):
    df = table(spark, ["b", "a", "c", "a"])
    got = sorted((r.field, r["rank"], r.item) for r in top_k(df, {"x": F.col("item"), "y": F.upper("item")}, 5).collect())
    assert got == [("x", 1, "a"), ("x", 2, "b"), ("x", 3, "c"), ("y", 1, "A"), ("y", 2, "B"), ("y", 3, "C")]
    assert [r.item for r in top_k(table(spark, ["b", "a", "c"]), {"x": F.col("item")}, 2).orderBy("rank").collect()] == ["a", "b"]


def test_empty_nulls_and_long_values(spark):
    for df in (table(spark, []), table(spark, [None, "", None])):
        assert top_k(df, {"x": F.col("item")}, 3).count() == 0 and by_share(df, {"x": F.col("item")}, 1, 100).count() == 0
    long = "é" * 500_000
    assert by_share(table(spark, [long, long, "b"]), {"x": F.col("item")}, 1, 2).first().item == long
    assert {r.item for r in top_k(table(spark, ["", "", "a"]), {"x": F.col("item")}, 3, keep_empty=True).collect()} == {"", "a"}
