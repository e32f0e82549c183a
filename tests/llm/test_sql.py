import pytest

from runweave.llm import queries as llm

from ..oracle import both


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_same_rows_as_sql(spark, data, name):
    ours, theirs = both(spark, data, llm.QUERIES[name], llm.SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.SQL)))
def test_runs_and_repeats(spark, data, name):
    first = sorted(map(tuple, llm.QUERIES[name](spark, data).collect()), key=repr)
    assert first and len(first) == len(set(first))
    if name.endswith("_found"):
        assert first == sorted(map(tuple, llm.QUERIES[name](spark, data).collect()), key=repr)


def test_found_columns(spark, data):
    want = {
        "p1_found": {"field": "string", "item": "string"}, "p2_found": {"title_a": "string", "title_b": "string"}, "p3_found": {"track_id": "bigint", "field": "string"},
        "p4_found": {"set_id": "string", "first_ts": "bigint", "last_ts": "bigint"}, "p6_found": {"track_id": "bigint", "field": "string", "artist_id": "bigint"},
        "p7_found": {"keep_id": "bigint", "dup_id": "bigint"}, "p9_found": {"doc_id": "bigint", "item_id": "bigint"}, "p10_found": {"doc_id": "bigint"},
    }
    assert {n: dict(llm.QUERIES[n](spark, data).dtypes) for n in want} == want
