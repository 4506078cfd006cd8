"""Group-by with aggregate expressions given as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_agg(
    df: DataFrame,
    group: str | Sequence[str],
    expressions: Sequence[str],
    having: str | None = None,
) -> DataFrame:
    """``select group, expressions .. group by group having ..``.

    ``group`` may be the comma-separated text of plain column names. Any Spark aggregate works in the
    expressions; ``having`` may use their aliases.
    """
    names = [g.strip() for g in group.split(",")] if isinstance(group, str) else list(group)
    grouped = df.groupBy(*names).agg(*[F.expr(e) for e in expressions])
    return grouped.where(F.expr(having)) if having else grouped
