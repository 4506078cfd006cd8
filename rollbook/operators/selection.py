"""Rows of a sorted frame from one place to another, without sorting the frame.

A few rows are taken as marks, and one pass counts the rows before each of them. The marks around the wanted places bound the slice that
holds them; it is narrowed again until it is small enough to be sorted. A pass reads the sort columns, and nothing is shuffled but counts.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.ordering import direction, sort_column

# Marks of one pass; each pass leaves about one part in so many.
MARKS = 31
Mark = list[Column]


def _before(column: Column, mark: Column, way: str) -> Column:
    """Whether a value stands before a mark in one sort column."""
    nulls_first = way in ("asc", "desc nulls first")
    step = column < mark if way.startswith("asc") else column > mark
    known = F.when(column.isNull(), nulls_first).otherwise(step)
    return F.when(mark.isNull(), F.lit(False) if nulls_first else column.isNotNull()).otherwise(known)


def _rows_before(order: Sequence[tuple[str, str]], mark: Mark) -> Column:
    """Whether a row stands before a mark: at the first sort column that differs."""
    tests = []
    for i, (name, way) in enumerate(order):
        same = [F.col(n).eqNullSafe(m) for (n, _), m in zip(order[:i], mark)]
        tests.append(reduce(operator.and_, [*same, _before(F.col(name), mark[i], way)]))
    return reduce(operator.or_, tests)


def select_range(df: DataFrame, order: Sequence[tuple[str, str]], offset: int, count: int, enough: int) -> DataFrame:
    """``count`` rows behind the first ``offset``, in ``order``; slices of up to ``enough`` rows are sorted.

    ``order`` names columns of simple types. Equal rows can't be parted, so a slice of nothing but them is taken as it is. Beyond the last row there are none.
    """
    order = [(name, direction(way)) for name, way in order]
    kinds = [df.schema[name].dataType for name, _ in order]
    if any(isinstance(k, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) for k in kinds):
        raise TypeError(f"can't page deep by {[n for n, _ in order]}: simple types are needed")
    sort = [sort_column(name, way) for name, way in order]
    # as text, which reads back as the same value whatever the type
    shown = [F.col(name).cast("string").alias(name) for name, _ in order]
    left, size = df, None
    while size is None or size > enough + count:
        marks = left.select(*[n for n, _ in order]).orderBy(F.xxhash64(*[n for n, _ in order])).limit(MARKS).distinct()
        values = [[F.lit(v).cast(k) for v, k in zip(row, kinds)] for row in marks.orderBy(*sort).select(*shown).collect()]
        tests = [_rows_before(order, mark) for mark in values]
        seen = left.agg(F.count(F.lit(1)), *[F.count(F.when(t, 1)) for t in tests]).first()
        total, places = seen[0], list(seen[1:])
        low = max((i for i, n in enumerate(places) if n <= offset), default=None)
        high = min((i for i, n in enumerate(places) if n >= offset + count), default=None)
        start, stop = 0 if low is None else places[low], total if high is None else places[high]
        if low is not None:
            left = left.where(~tests[low])
        if high is not None:
            left = left.where(tests[high])
        offset -= start
        if stop - start in (size, total):  # no mark parts what is left
            break
        size = stop - start
    return left.orderBy(*sort).offset(offset).limit(count)
