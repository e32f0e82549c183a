"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, small: DataFrame, on: str, by: str, how: str = "left", salts: int = 16) -> DataFrame:
    """``rows`` joined to ``small`` on ``on``. ``small`` holds each key once, so it is written once per salt, and the rows of one
    key are spread over ``salts`` tasks by a hash of the column ``by``. Salts follow from the row alone, so a task
    that is run again sends its rows where it sent them before."""
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted, [on, "_salt"], how).drop("_salt")
