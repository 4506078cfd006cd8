"""Positions of rows within their key, without ever sorting a huge key in one task.

``row_number() over (partition by key order by ..)`` sends all rows of a key to one task. That is the
best plan while keys are small, but a key here can hold a third of a table. So the rows per key are
counted first (a count combines on the map side and reads only the key). Keys of more than ``hot_rows``
rows are cut where the data says, whatever the type or look of the sort values:

1. their rows are dealt by ranges of (key, order, tie) into pieces of about half of ``hot_rows``, and written
   as a table, so that every later step sees the same pieces;
2. rows are numbered inside their piece;
3. the rows of earlier pieces of the key are added, from one count per piece.

Other keys stay in one window each. Spark samples to place the cuts, but no number depends on where they are.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.ordering import sort_column
from rollbook.operators.tables import kept

# Rows of one key that a single task sorts without strain.
HOT_ROWS = 4_000_000
# Rows that are worth a piece of their own, however low a caller sets the bound of a hot key.
LEAST_PIECE = 40_000
# Hot keys, or pieces of them, up to this count are broadcast; beyond it Spark joins them as it sees fit.
BROADCAST_KEYS = 100_000
# When only so many first rows of a key are wanted, Spark drops the others before the shuffle.
FIRST_ROWS = 100


def key_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: tuple[str, str] | Sequence[tuple[str, str]],
    tie: str | None,
    name: str = "pos",
    hot_rows: int = HOT_ROWS,
    first: int | None = None,
    made: bool = False,
) -> DataFrame:
    """Number the rows of every key from 1, by ``(column, way)`` or several of them, then by ``tie``.

    The tie-break should be unique within the key; without one, equal rows come in any order, and rows
    with equal sort values can't be parted. Rows without a key are left out: no listing asks for them. No keys at
    all means one numbering of the whole table. ``first`` keeps only the first rows of every key, without numbering
    the rest. ``made`` tells that the rows come from joins or aggregates: they are written as a table first, as they are read more than once.
    """
    keys = list(keys)
    sorts = [order] if isinstance(order[0], str) else list(order)
    sort = [sort_column(column, way) for column, way in sorts]
    sort += [F.col(tie).asc()] if tie else []
    if keys:
        df = df.where(reduce(operator.and_, [F.col(k).isNotNull() for k in keys]))
    if first is not None and first <= FIRST_ROWS:
        return _plain(df, keys, sort, name).where(F.col(name) <= first)
    if made:
        df = kept(df, "ranked-rows")  # counted and ranked; what it takes to make the rows is done once
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    n_hot, total = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not n_hot:
        ranked = _plain(df, keys, sort, name)
    elif not keys:
        ranked = _in_pieces(df, keys, sort, name, total, hot_rows)
    else:
        marks = hot.select(*keys, F.lit(True).alias("_hot"))
        rows = df.join(F.broadcast(marks) if n_hot <= BROADCAST_KEYS else marks, keys, "left")
        large = _in_pieces(rows.where("_hot").drop("_hot"), keys, sort, name, total, hot_rows)
        ranked = _plain(rows.where("_hot is null").drop("_hot"), keys, sort, name).unionByName(large)
    return ranked if first is None else ranked.where(F.col(name) <= first)


def _plain(df: DataFrame, keys: list[str], sort: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*sort)).cast("bigint"))


def pieces_of(df: DataFrame, keys: list[str], sort: list, total: int, hot_rows: int) -> DataFrame:
    """The rows with the number of their piece; pieces of a key follow its order."""
    n = n_pieces(total, hot_rows)
    dealt = df.repartitionByRange(n, *[F.col(k) for k in keys], *sort)
    return kept(dealt.withColumn("_piece", F.spark_partition_id()), "pieces")


def n_pieces(total: int, hot_rows: int) -> int:
    """Pieces of about half of ``hot_rows``, but not so small that there are more tasks than work."""
    return max(1, math.ceil(2 * total / max(hot_rows, LEAST_PIECE)))


def _in_pieces(df: DataFrame, keys: list[str], sort: list, name: str, total: int, hot_rows: int) -> DataFrame:
    rows = pieces_of(df, keys, sort, total, hot_rows)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*keys, "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # as many rows as pieces, and one more for each key whose border lies inside a piece, so their count is looked at
    few = sizes.count() <= BROADCAST_KEYS
    inside = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*sort))
    numbered = rows.withColumn("_pos", inside).join(F.broadcast(before) if few else before, [*keys, "_piece"])
    return numbered.withColumn(name, F.col("_pos") + F.col("_before")).drop("_piece", "_pos", "_before")
