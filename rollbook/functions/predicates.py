"""Filters given as data, turned into one Column.

A filter is a list of ``(column, value, way, mode)``: ``way`` is the comparison, ``mode`` (``and`` /
``or``) ties the item to the next one. ``and`` binds tighter than ``or``; ``sub`` nests a list.
Membership takes a list of values, or the text of a SQL list such as ``('a', 'b')``.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Item = tuple[str, object, str, str]

COMPARE = {
    "=": operator.eq,
    "!=": operator.ne,
    "<>": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "<=>": Column.eqNullSafe,
    "regexp": Column.rlike,
    "rlike": Column.rlike,
    "not regexp": lambda column, pattern: ~column.rlike(pattern),
    "not rlike": lambda column, pattern: ~column.rlike(pattern),
}
PATTERNS = ("regexp", "rlike", "not regexp", "not rlike")


def contains(column: Column | str, keyword: str, ci: bool = False) -> Column:
    """``LIKE %keyword%``: ``%`` and ``_`` stay wildcards, a backslash is an ordinary character."""
    column = F.col(column) if isinstance(column, str) else column
    pattern = "%" + keyword.replace("\\", "\\\\") + "%"
    if ci:
        return F.collate(column, "UTF8_LCASE").like(pattern)
    return column.like(pattern)


def normalize_keyword(keyword: str | None) -> str:
    """Search text as listings take it: without any space; nothing at all means no keyword."""
    return (keyword or "").replace(" ", "")


def keyword_filter(
    keyword: str | None, columns: Sequence[str], ci: bool = False, normalize: bool = True
) -> Column:
    """The keyword in any of the columns; true for every row when there is no keyword."""
    keyword = normalize_keyword(keyword) if normalize else keyword
    if not keyword or not columns:
        return F.lit(True)
    return reduce(operator.or_, [contains(c, keyword, ci) for c in columns])


def predicate(item: Item, ci: bool = False) -> Column:
    key, value, way, _ = item
    way = " ".join(way.lower().split())
    if way == "sub":
        return where(value, ci)
    column = F.col(key)
    if way in ("like", "not like"):
        found = contains(column, value, ci)
        return found if way == "like" else ~found
    if way in PATTERNS:
        return COMPARE[way](column, f"(?i){value}" if ci else value)
    if ci and isinstance(value, str):
        column = F.collate(column, "UTF8_LCASE")
    if way in COMPARE:
        return COMPARE[way](column, F.lit(value))
    if way in ("in", "not in"):
        # SQL membership: a NULL column matches neither form.
        member = _member(column, key, value)
        return member if way == "in" else ~member
    if way == "between":
        low, high = value
        return column.between(low, high)
    raise ValueError(f"unknown comparison {way!r}")


def _member(column: Column, key: str, value: object) -> Column:
    if not isinstance(value, str):
        return column.isin(list(value))
    text = value.strip()
    if not (text.startswith("(") and text.endswith(")")):
        raise ValueError(f"membership in {value!r}: a list of values or its SQL text in brackets is needed")
    return F.expr(f"`{key}` IN {text}")


def where(items: Sequence[Item] | None, ci: bool = False) -> Column:
    """The whole list as one Column; the mode of the last item is ignored."""
    if not items:
        return F.lit(True)
    groups: list[list[Column]] = [[]]
    for position, item in enumerate(items):
        groups[-1].append(predicate(item, ci))
        if position == len(items) - 1:
            break
        mode = (item[3] or "").lower()
        if mode == "or":
            groups.append([])
        elif mode != "and":
            raise ValueError(f"unknown connector {item[3]!r}")
    return reduce(operator.or_, [reduce(operator.and_, group) for group in groups])


def items_from_kwargs(
    keyword: str | None = None, match_range: Sequence[str] = (), **filters: object
) -> list[Item]:
    """Equality per name; a ``_list`` suffix means membership; ``None`` and ``[]`` filter nothing.

    ``keyword`` is searched in all the ``match_range`` columns.
    """
    items: list[Item] = []
    if keyword and match_range:
        items.append(("", [(c, keyword, "like", "or") for c in match_range], "sub", "and"))
    for name, value in filters.items():
        if value is None:
            continue
        if not name.endswith("_list"):
            items.append((name, value, "=", "and"))
        elif len(value) > 0:
            items.append((name.removesuffix("_list"), list(value), "in", "and"))
    return items


def where_kwargs(ci: bool = False, **filters: object) -> Column:
    return where(items_from_kwargs(**filters), ci)


def is_live() -> Column:
    """Rows that are not soft-deleted."""
    return F.col("status") == 1
