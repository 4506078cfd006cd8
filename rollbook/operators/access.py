"""Who may read what."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.predicates import is_live
from rollbook.operators.joins import left_join
from rollbook.operators.page_requests import Pages, page_requests
from rollbook.operators.ranking import HOT_ROWS

# The role each resource is open to.
RESOURCE_ROLES = {
    "class": "teacher",
    "student": "teacher",
    "course": "teacher",
    "course_score": "teacher",
    "own_score": "student",
}
# Resources of which a user sees only the own rows, and the column naming the owner.
OWNED_RESOURCES = {"course": "teacher_uid", "own_score": "student_uid"}


def allowed() -> Column:
    """Role test on ``identity`` and ``resource``; unknown resources and roles are refused."""
    test = F.lit(False)
    for resource, role in RESOURCE_ROLES.items():
        test = test | ((F.col("resource") == resource) & (F.col("identity") == role))
    return F.coalesce(test, F.lit(False))


def scoped_read(requests: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Requests ``(identity, user_uid, resource)`` with the verdict and the live rows they reach.

    ``tables`` maps a resource to its table. Owned resources count the user's rows, open ones the
    whole table. The counts are made per owner before the join, so no request is multiplied.
    """
    owned, totals = None, None
    for resource, table in tables.items():
        live = table.where(is_live())
        if resource in OWNED_RESOURCES:
            owner = F.col(OWNED_RESOURCES[resource]).cast("string").alias("owner")
            counts = live.groupBy(owner).agg(F.count(F.lit(1)).alias("own_rows"))
            counts = counts.withColumn("resource", F.lit(resource))
            owned = counts if owned is None else owned.unionByName(counts)
        else:
            counts = live.agg(F.count(F.lit(1)).alias("all_rows"))
            counts = counts.withColumn("resource", F.lit(resource))
            totals = counts if totals is None else totals.unionByName(counts)

    asked = requests.withColumn("allowed", allowed())
    visible = F.lit(0)
    if totals is not None:
        # one row per resource
        asked = asked.join(F.broadcast(totals), "resource", "left")
        visible = F.coalesce("all_rows", visible)
    if owned is not None:
        # other requests have no owner and need no partner
        mine = F.col("resource").isin(*OWNED_RESOURCES) & F.col("allowed")
        asked = asked.withColumn("owner", F.when(mine, F.col("user_uid").cast("string")))
        asked = left_join(asked, owned, ["resource", "owner"])
        visible = F.coalesce("own_rows", visible)
    visible = F.when(F.col("allowed"), visible).otherwise(0).cast("bigint")
    return asked.select(*requests.columns, "allowed", visible.alias("visible"))


class Listing(NamedTuple):
    """What a resource shows: its table, the columns shown, the column that orders it and the one that breaks ties."""

    table: DataFrame
    columns: Sequence[str]
    order: str
    tie: str


class Scoped(NamedTuple):
    pages: dict[str, Pages]  # per resource: the rows of each request's page, and totals
    refused: DataFrame  # requests that may not read what they ask for: request_id, resource, reason


def scoped_rows(requests: DataFrame, listings: dict[str, Listing], hot_rows: int = HOT_ROWS) -> Scoped:
    """The rows that each request may see, page by page.

    ``requests`` have ``request_id``, ``identity``, ``user_uid``, ``resource``, ``page``, ``size`` and ``direction``. Of owned resources a
    user pages through the own rows, of open ones through the whole table. The rows of an owner are ranked once, whatever the number of requests
    that ask for them, and owners with very many rows are ranked in pieces. A role that may not read a resource, and a resource without a listing, are
    ``forbidden``; requests for impossible pages are rejected with the reason of ``page_requests``.
    """
    judged = requests.withColumn("_allowed", allowed() & F.col("resource").isin(*listings))
    fine = judged.where("_allowed")
    pages = {}
    for resource, listing in listings.items():
        mine = fine.where(F.col("resource") == resource).select("request_id", F.col("user_uid").cast("string").alias("_owner"), "page", "size", "direction")
        owner = OWNED_RESOURCES.get(resource)
        table = listing.table.withColumn("_owner", F.col(owner).cast("string")) if owner else listing.table
        keys = ["_owner"] if owner else []
        found = page_requests(mine if owner else mine.drop("_owner"), table, keys, listing.columns, listing.order, listing.tie, hot_rows)
        pages[resource] = found._replace(rows=found.rows.drop("_owner"))
    refused = judged.where(~F.coalesce("_allowed", F.lit(False))).select("request_id", "resource", F.lit("forbidden").alias("reason"))
    for resource, found in pages.items():
        refused = refused.unionByName(found.rejected.select("request_id", F.lit(resource).alias("resource"), "reason"))
    return Scoped(pages, refused)
