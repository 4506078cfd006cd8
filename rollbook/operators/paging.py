"""Sorted pages, for every key at once or for one filtered query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.ordering import direction, order_pairs, ordered
from rollbook.functions.predicates import is_live, keyword_filter, where_kwargs
from rollbook.operators.ranking import HOT_ROWS, key_rank
from rollbook.operators.selection import select_range

# ``offset + limit`` rows pass through the driver in Spark's top-k plan; beyond this many, rank instead.
TOP_ROWS = 100_000


def check_page(page: int, size: int) -> None:
    if page < 1 or size < 1:
        raise ValueError(f"pages and page sizes start at 1, got page {page} of size {size}")


def paginate(page: int, size: int = 20) -> tuple[int, int]:
    """``(offset, count)`` of a page counted from 1; page 0 is the first page too."""
    return max(page - 1, 0) * size, size


def pages(
    df: DataFrame,
    keys: Sequence[str],
    order: tuple[str, str] | Sequence[tuple[str, str]],
    tie: str | None,
    size: int = 20,
    page: int | None = None,
    hot_rows: int = HOT_ROWS,
    made: bool = False,
) -> DataFrame:
    """All pages of all keys: the rows with ``page`` and ``pos`` (both from 1).

    With ``page`` only that page of every key; the rows behind it are dropped while ranking. ``made`` as in ``key_rank``.
    """
    check_page(1 if page is None else page, size)
    first = None if page is None else page * size
    ranked = key_rank(df, keys, order, tie, "pos", hot_rows, first, made)
    number = F.floor((F.col("pos") - 1) / size).cast("bigint") + 1
    ranked = ranked.withColumn("pos", F.col("pos").cast("bigint")).withColumn("page", number)
    return ranked if page is None else ranked.where(F.col("page") == page)


def listing(
    table: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: tuple[str, str],
    tie: str,
    size: int = 20,
    keyword: str = "",
    keyword_columns: Sequence[str] = (),
    page: int | None = None,
    hot_rows: int = HOT_ROWS,
    made: bool = False,
) -> DataFrame:
    """Live rows, with the keyword in one of its columns, paged per key."""
    rows = table.where(is_live() & keyword_filter(keyword, keyword_columns))
    needed = list(dict.fromkeys([*keys, *columns, order[0], tie]))
    paged = pages(rows.select(*needed), keys, order, tie, size, page, hot_rows, made)
    return paged.select(*dict.fromkeys([*keys, *columns]), "page", "pos")


def query(
    table: DataFrame,
    filters: Mapping[str, object] | None = None,
    columns: Sequence[str] | None = None,
    order: str | Sequence[tuple[str, str]] = "",
    page: int = 0,
    per_page: int = 1,
    key: str | Sequence[str] | None = None,
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """Filter, sort and page by keyword arguments. Without a page, all rows.

    ``key`` names the columns that tell rows apart, by default the first column. Rows are sorted by ``order`` and
    then by the key, so pages never overlap; without an order, by the key alone.
    """
    rows = table.where(where_kwargs(**(filters or {})))
    rows = order_page(rows, order, page, per_page, key, top_rows) if page else ordered(rows, _whole_order(rows, order, key))
    return rows.selectExpr(*columns) if columns else rows


def _whole_order(df: DataFrame, order: str | Sequence[tuple[str, str]], key: str | Sequence[str] | None) -> str | list[tuple[str, str]]:
    """The order with the key behind it, in the form it was given."""
    keys = [df.columns[0]] if key is None else [key] if isinstance(key, str) else list(key)
    pairs = order_pairs(order)
    pairs += [(k, "asc") for k in keys if k not in [name for name, _ in pairs]]
    return ", ".join(f"{name} {way}" for name, way in pairs) if isinstance(order, str) else pairs


def order_page(
    df: DataFrame,
    order: str | Sequence[tuple[str, str]],
    page: int,
    size: int,
    key: str | Sequence[str] | None = None,
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """One page of a whole frame, sorted by ``order`` and then the key (see ``query``), at any depth.

    Spark runs the first pages as a top-k that gathers ``page * size`` rows in one place. For pages that end beyond
    ``top_rows`` the slice of the order that holds the page is narrowed by counts first (``selection``), so that only the slice is sorted. Both give the
    same rows in the same order.
    """
    check_page(page, size)
    offset, count = paginate(page, size)
    whole = _whole_order(df, order, key)
    if offset + count <= top_rows:
        return ordered(df, whole).offset(offset).limit(count)
    pairs = order_pairs(whole)
    named = df.withColumns({f"_by{i}": F.expr(name) if isinstance(whole, str) else F.col(name) for i, (name, _) in enumerate(pairs)})
    return select_range(named, [(f"_by{i}", way) for i, (_, way) in enumerate(pairs)], offset, count, top_rows).select(*df.columns)


def first_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | tuple[str, str]], columns: Sequence[str]
) -> DataFrame:
    """The first row of every key by ``order``, columns or ``(column, way)`` pairs.

    Ascending orders are an aggregate, which combines before the shuffle; so does the first place of a ranking.
    """
    pairs = [(o, "asc") if isinstance(o, str) else o for o in order]
    if all(direction(way) == "asc" for _, way in pairs):
        row = F.struct(*[F.col(c) for c in columns])
        lowest = F.min_by(row, F.struct(*[F.col(c) for c, _ in pairs])).alias("_row")
        return df.groupBy(*keys).agg(lowest).select(*keys, "_row.*")
    return key_rank(df, keys, pairs, None, "_first", first=1).select(*keys, *[c for c in columns if c not in keys])


def first_match(
    df: DataFrame,
    filters: Mapping[str, object],
    order: str | Sequence[tuple[str, str]],
    columns: Sequence[str] | None = None,
    key: str | Sequence[str] | None = None,
) -> DataFrame:
    """The first row of one filtered, sorted query: at most one row."""
    return query(df, filters, columns, order, page=1, per_page=1, key=key)


def count_active(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Live rows per key."""
    return df.where(is_live()).groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))


def page_counts(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Rows and pages per key, or of the whole frame (0 and 0 when empty)."""
    check_page(1, size)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return counts.withColumn("total_page", F.ceil(F.col("total") / size).cast("bigint"))


def query_counts(
    table: DataFrame, filters: Mapping[str, object] | None = None, per_page: int = 1
) -> DataFrame:
    """Totals of a filtered query."""
    return page_counts(table.where(where_kwargs(**(filters or {}))), [], per_page)
