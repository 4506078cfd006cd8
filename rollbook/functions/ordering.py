"""Sort orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


WAYS = {
    "asc": "asc",
    "desc": "desc",
    "asc nulls first": "asc",
    "desc nulls last": "desc",
    "asc nulls last": "asc nulls last",
    "desc nulls first": "desc nulls first",
}


def direction(text: str) -> str:
    """``asc`` or ``desc``, perhaps with the place of NULLs where it is not the usual one; anything else is refused before a plan is built."""
    way = " ".join(text.lower().split())
    if way not in WAYS:
        raise ValueError(f"order must be ASC or DESC, perhaps with NULLS FIRST or LAST, not {text!r}")
    return WAYS[way]


def sorted_by(column: Column, way: str = "asc") -> Column:
    """NULLs first when ascending, last when descending, unless told otherwise."""
    way = direction(way)
    if way == "asc":
        return column.asc()
    if way == "desc":
        return column.desc()
    return column.asc_nulls_last() if way == "asc nulls last" else column.desc_nulls_first()


def sort_column(name: str, way: str = "asc") -> Column:
    return sorted_by(F.col(name), way)


def order_pairs(order: str | Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """``(expression, way)`` pairs of an order, given as such or as the text of an ORDER BY clause."""
    if not isinstance(order, str):
        return [order] if order and isinstance(order[0], str) else list(order)
    parts, depth, start = [], 0, 0
    for at, sign in enumerate(order + ","):
        depth += (sign == "(") - (sign == ")")
        if sign == "," and depth == 0:
            parts.append(order[start:at].split())
            start = at + 1
    pairs = []
    for words in filter(None, parts):
        last = [w.lower() for w in words]
        nulls = " ".join(last[-2:]) if last[-2:] in (["nulls", "first"], ["nulls", "last"]) else ""
        if nulls:
            del words[-2:], last[-2:]
        way = words.pop().lower() if last and last[-1] in ("asc", "desc") else "asc"
        if not words:
            raise ValueError(f"no column to sort by in {order!r}")
        pairs.append((" ".join(words), direction(f"{way} {nulls}")))
    return pairs


def ordered(df: DataFrame, order: str | Sequence[tuple[str, str]]) -> DataFrame:
    """Sorted by ``[(column, way), ..]`` or by the text of an ORDER BY clause."""
    columns = [(F.expr(name) if isinstance(order, str) else F.col(name), way) for name, way in order_pairs(order)]
    return df.orderBy(*[sorted_by(c, way) for c, way in columns])
