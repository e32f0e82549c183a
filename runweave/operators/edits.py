"""Folding a log of edits into the rows that they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(log: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """log: keys, seq, action ('toggle' or 'edit'), artist, title, before_artist, before_title.

    rejected by the parity of toggles; names of the last edit; original_* are the names before the first edit,
    as later ones do not overwrite them."""
    order = F.struct(*seq)
    edit = F.col("action") == "edit"
    last = lambda c: F.max_by(F.when(edit, F.struct(F.col(c).alias("v"))), F.when(edit, order))["v"]
    first = lambda c: F.min_by(F.when(edit, F.struct(F.col(c).alias("v"))), F.when(edit, order))["v"]
    return log.groupBy(*keys).agg(
        (F.sum((F.col("action") == "toggle").cast("bigint")) % 2 == 1).alias("rejected"),
        last("artist").alias("artist"), last("title").alias("title"), first("before_artist").alias("original_artist"), first("before_title").alias("original_title"), F.sum(edit.cast("bigint")).alias("edits"),
    )
