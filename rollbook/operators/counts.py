"""Counts kept up to date from the rows that a feed reached."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.predicates import is_live


def update_counts(counts: DataFrame, before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Live rows per key (``total``) once the rows ``before`` have become those ``after``; keys without any are left out.

    Rows as they were are taken back, rows as they are added, so that a row may change its key, die or come to life. Only the rows
    that a feed reached are read, not the table; ``counts`` are those of the table before it.
    """
    keys = list(keys)

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        return rows.where(is_live()).groupBy(*keys).agg((F.count(F.lit(1)) * sign).alias("total"))

    whole = counts.select(*keys, "total").unionByName(signed(before, -1)).unionByName(signed(after, 1))
    return whole.groupBy(*keys).agg(F.sum("total").alias("total")).where("total > 0")
