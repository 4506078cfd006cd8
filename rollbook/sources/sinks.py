"""Append and time-bucketed writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text form of the three bucket widths.
BUCKET_FORMATS = {"month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH"}


def append_rows(table: DataFrame, *batches: DataFrame) -> DataFrame:
    """The table with further rows, matched by column name; columns a batch lacks become NULL."""
    extra = [b for batch in batches for b in set(batch.columns) - set(table.columns)]
    if extra:
        raise ValueError(f"columns not in the table: {sorted(extra)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches, table)


def aligned(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows in the columns of a table: matched by name, missing ones NULL, types as they are there.

    A column the table has not, a type that differs, or a missing column that may not be NULL is refused.
    """
    given = {f.name: f.dataType for f in rows.schema.fields}
    extra = sorted(given.keys() - set(schema.names))
    wrong = sorted(f.name for f in schema.fields if f.name in given and given[f.name] != f.dataType)
    bare = sorted(f.name for f in schema.fields if f.name not in given and not f.nullable)
    for names, problem in ((extra, "columns not in the table"), (wrong, "types differ"), (bare, "columns must be given")):
        if names:
            raise ValueError(f"{problem}: {names}")
    return rows.select(*[F.col(f"`{f.name}`") if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_append(rows: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Add rows to a Parquet table without reading its rows.

    They must fit ``schema``, by default that of the files there. Give it for a table that is still empty.
    """
    schema = schema or rows.sparkSession.read.parquet(path).schema
    aligned(rows, schema).write.mode("append").parquet(path)


def bucket(ts: Column | str, way: str = "day") -> Column:
    """The month, day or hour a moment falls into, as text; any other width counts as a day."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(ts, BUCKET_FORMATS.get(way, BUCKET_FORMATS["day"]))


def write_buckets(rows: DataFrame, ts: str, way: str, path: str, mode: str = "append") -> None:
    """One folder per time bucket.

    The rebalance hint lets Spark put small buckets together and split a bucket that holds most of
    the rows over many tasks, so files come out at a sensible size whatever the skew.
    """
    rows = rows.withColumn("bucket", bucket(ts, way))
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").mode(mode).parquet(path)
