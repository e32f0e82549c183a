import pytest

from runweave.plans import queries as core

from .oracle import both


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows_as_sql(spark, data, name):
    ours, theirs = both(spark, data, core.QUERIES[name], core.SQL[name])
    assert ours == theirs
    assert ours or name in ("resume_anti", "membership_semi")


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, data, name):
    assert core.QUERIES[name](spark, data).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "dedup_samples" in e.queries()
