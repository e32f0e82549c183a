import pytest
from pyspark.sql import functions as F

from runweave.operators.joins import spread_join
from runweave.operators.runs import collapse, in_chunks
from runweave.operators.signals import slices


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_spread_join_is_a_join(spark, how):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 50) END AS k")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), (None, 4)], "k string, v int")
    got = spread_join(rows, small, "k", "id", how)
    want = rows.join(small, "k", how)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert spread_join(rows.limit(0), small, "k", "id", how).count() == 0 and spread_join(rows, small.limit(0), "k", "id", how).count() in (0, 1000)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_slices_in_blocks(spark, block):
    lengths = [0, 1, 29_999, 30_000, 30_001, 300_500, -5, None]
    df = spark.createDataFrame([(f"s{i}", d) for i, d in enumerate(lengths)], "s string, d bigint")
    want = sorted((f"s{i}", k, p // 1000, p, min(p + 30_000, d)) for i, d in enumerate(lengths) if d and d > 0 for k, p in enumerate(range(0, d, 30_000)))
    got = slices(df, "d", block=block).select("s", "sample_idx", "ts", "start_ms", "end_ms").collect()
    assert sorted(map(tuple, got)) == want


def test_last_delivery_and_what_is_done_afterwards(spark):
    rows = [("s", i, r, k) for i, r, k in [(0, 1, "b"), (0, 2, "a"), (1, 1, "a"), (2, 1, "x"), (2, 1, "y"), (3, 1, None), (4, 5, "c"), (4, 4, "d"), (5, 1, "C")]] + [(None, 1, 1, "a"), ("s", None, 1, "a")]
    df = spark.createDataFrame(rows, "s string, i bigint, r int, k string")
    assert sorted((x.i, x.k) for x in in_chunks(df, "s", "i", ["r", "k"], width=2).collect()) == [(0, "a"), (1, "a"), (2, "y"), (3, None), (4, "c"), (5, "C")]
    out = collapse(df, "s", "i", F.col("k"), ["k"], width=2, order=["r", "k"], then=lambda x: x.withColumn("k", F.lower("k")))
    assert sorted((x.i, x.matched, x.run) for x in out.collect()) == [(0, True, 1), (2, False, 1), (4, True, 2)]
