"""Writes that need no rules of a record type: insert-or-update, filtered update, soft delete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.operators.joins import left_join


def upsert_explicit(
    table: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    update: Mapping[str, object],
    order: Sequence[str],
    now: str = "ts",
) -> DataFrame:
    """Insert rows; where the key is present already, apply ``update`` instead of the row's values.

    ``update`` maps columns to a value, to a Column over the incoming row, or to ``"now()"``, which is
    the incoming row's ``now`` column. Of several rows with one key the first (by ``order``) inserts
    and the last one updates. Rows are reduced per key before they meet the table.
    """
    keys = list(keys)
    fields = [c for c in table.columns if c not in keys]
    at = F.struct(*[F.col(c) for c in order])
    values = {c: (F.col(now) if v == "now()" else v) if isinstance(v, str) else v
              for c, v in update.items()}
    new = F.struct(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in fields])
    upd = F.struct(
        *[(v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in values.items()]
    )
    feed = rows.groupBy(*keys).agg(
        F.min_by(new, at).alias("_new"),
        F.max_by(upd, at).alias("_upd"),
        F.count(F.lit(1)).alias("_n"),
    )
    joined = table.withColumn("_known", F.lit(True)).join(feed, keys, "full_outer")
    known, fed = F.col("_known").isNotNull(), F.col("_n").isNotNull()
    repeated = fed & (known | (F.col("_n") > 1))
    out = []
    for c in fields:
        inserted = F.when(known, F.col(c)).otherwise(F.col(f"_new.{c}"))
        if c in values:
            inserted = F.when(repeated, F.col(f"_upd.{c}")).otherwise(inserted)
        out.append(inserted.cast(table.schema[c].dataType).alias(c))
    return joined.select(*keys, *out).select(*table.columns)


def patch_update(table: DataFrame, matched: Column, values: Mapping[str, object]) -> DataFrame:
    """Set columns on the matching rows. A NULL match counts as no match; no values, no change."""
    columns = {
        c: F.when(matched, v if isinstance(v, Column) else F.lit(v))
        .otherwise(F.col(c))
        .cast(table.schema[c].dataType)
        for c, v in values.items()
    }
    # one select, so that the match is tested on the old values of all columns
    return table.select(*[columns.get(c, F.col(c)).alias(c) for c in table.columns])


def affected_counts(updates: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Per update, how many rows its key values match; an update that matches none has failed."""
    sizes = table.groupBy(*on).agg(F.count(F.lit(1)).alias("affected"))
    return (
        left_join(updates, sizes, on)
        .withColumn("affected", F.coalesce("affected", F.lit(0)))
        .withColumn("accepted", F.col("affected") > 0)
    )


def soft_delete(
    table: DataFrame, deletes: DataFrame, on: Sequence[str], ts: str = "ts"
) -> tuple[DataFrame, DataFrame]:
    """Rows named by the deletes get status 0 and their ``updated``; dependent tables stay as they are.

    ``on`` may hold the owner next to the uid. Second result: the keys that match no row.
    """
    on = list(on)
    last = deletes.groupBy(*on).agg(F.max(ts).alias("_ts"))
    joined = table.withColumn("_known", F.lit(True)).join(last, on, "full_outer")
    hit = F.col("_ts").isNotNull()
    kept = joined.where(F.col("_known")).select(
        *[
            F.when(hit, F.lit(0)).otherwise(F.col(c)).cast("int").alias(c) if c == "status"
            else F.coalesce("_ts", c).alias(c) if c == "updated"
            else F.col(c)
            for c in table.columns
        ]
    )
    missed = joined.where(F.col("_known").isNull()).select(
        *on, F.col("_ts").alias(ts), F.lit("no_match").alias("reason")
    )
    return kept, missed
