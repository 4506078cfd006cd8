"""Many listing requests answered together: each asks for a page of one key, of its own size and direction.

Rows are ranked once per direction. A request is an interval of positions, and a page of one key the rows whose positions lie in it. Positions
are cut into strips of ``STRIP``; a request meets the strips that its interval touches, so the join is one of equal keys, and what it
makes is the answer and at most two strips more per request.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.predicates import is_live
from rollbook.operators.joins import left_join
from rollbook.operators.lookup import semi_keys
from rollbook.operators.ranking import HOT_ROWS, key_rank
from rollbook.operators.tables import kept

# Keys asked for that are broadcast, up to this count.
BROADCAST_KEYS = 1_000_000
# Positions of a key that are joined as one.
STRIP = 64
WAYS = ("asc", "desc")


class Pages(NamedTuple):
    rows: DataFrame  # the request's id and page, the position of the row, its columns
    totals: DataFrame  # per request: total rows and pages of its key
    rejected: DataFrame  # requests that ask for no page, with the reason


def _checked(requests: DataFrame) -> DataFrame:
    """Requests with ``_way`` and the ``reason`` they are refused for."""
    way = F.lower(F.coalesce(F.col("direction"), F.lit("asc")))
    number = lambda c: F.coalesce(F.col(c) >= 1, F.lit(False))
    reason = F.when(~way.isin(*WAYS), "direction").when(~number("page"), "page").when(~number("size"), "size")
    return requests.withColumn("_way", way).withColumn("reason", reason)


def page_requests(
    requests: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: str,
    tie: str,
    hot_rows: int = HOT_ROWS,
    live: Column | None = None,
) -> Pages:
    """The rows that each request sees.

    ``requests`` have ``request_id``, the ``keys``, ``page`` and ``size`` (both from 1) and ``direction``, where NULL is ascending. Rows are those
    that are ``live``, by default not deleted, sorted by ``order`` and then by ``tie``. With no keys, requests page through the whole table. A request
    without a key, or beyond the last page, sees no rows; one with an impossible page, size or direction is rejected.
    """
    keys = list(keys)
    asked = _checked(requests)
    fine = asked.where("reason is null")
    needed = list(dict.fromkeys([*keys, *columns, order, tie]))
    rows = table.where(is_live() if live is None else live).select(*needed)
    if keys:
        # a set of keys that is small goes to the rows where they are read, before whatever makes the table out of them
        wanted = kept(fine.select(*keys).dropna().distinct(), "page-keys")
        few = wanted.count() <= BROADCAST_KEYS
        rows = rows.join(F.broadcast(wanted), keys, "left_semi") if few else semi_keys(rows, wanted, keys)
    rows = kept(rows, "page-rows")  # counted, and ranked both ways
    ranked = [key_rank(rows, keys, (order, way), tie, "pos", hot_rows).withColumn("_way", F.lit(way)) for way in WAYS]
    strips = ranked[0].unionByName(ranked[1]).withColumn("_strip", F.floor(F.col("pos") / STRIP).cast("bigint"))
    shown = [c for c in columns if c not in keys]
    strips = strips.select(*keys, "_way", "_strip", "pos", *[F.col(c).alias(f"_row_{c}") for c in shown])

    counted = _counted(fine, rows, keys)
    # no page reaches beyond the rows there are, so no request meets more strips than its rows fill
    last = F.col("page").cast("bigint") * F.col("size")
    spans = counted.select("request_id", *keys, "page", "_way", (last - F.col("size") + 1).alias("_from"), F.least(last, "total").alias("_to")).where("_from <= _to")
    touched = F.explode(F.sequence(F.floor(F.col("_from") / STRIP).cast("bigint"), F.floor(F.col("_to") / STRIP).cast("bigint")))
    spans = spans.withColumn("_strip", touched)
    met = left_join(spans, strips, [*keys, "_way", "_strip"], "inner").where("pos between _from and _to")
    found = met.select("request_id", *keys, "page", "pos", *[F.col(f"_row_{c}").alias(c) for c in shown])
    totals = counted.select("request_id", "total", F.ceil(F.col("total") / F.col("size")).cast("bigint").alias("total_page"))
    return Pages(found, totals, asked.where("reason is not null").select("request_id", "reason"))


def _counted(requests: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The requests with the ``total`` rows of their key."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    found = left_join(requests, counts, keys) if keys else requests.withColumn("total", F.lit(counts.first()[0]))
    return found.withColumn("total", F.coalesce("total", F.lit(0)))
