"""Many-to-one lookups, key sets and existence checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators.joins import left_join


def lookup(
    df: DataFrame, dimension: DataFrame, key: str, name: str, dimension_key: str | None = None
) -> DataFrame:
    """Add ``name`` from the dimension row with the same key; ``""`` where there is none.

    Deleted dimension rows still give their name. The row count never changes: the dimension is
    reduced to one name per key first. Whether to broadcast it is left to Spark, which knows its size.
    """
    keyed = dimension.select(F.col(dimension_key or key).alias(key), name).where(F.col(key).isNotNull())
    names = keyed.groupBy(key).agg(F.max(name).alias(name))
    return left_join(df, names, [key]).withColumn(name, F.coalesce(name, F.lit("")))


def profiles(students: DataFrame, teachers: DataFrame, classes: DataFrame) -> DataFrame:
    """Display name of every user: teachers by their name, students with their class in front."""
    pupils = lookup(students, classes, "class_uid", "class_name").select(
        F.lit("student").alias("identity"),
        F.col("student_uid").alias("user_uid"),
        F.concat_ws(" ", "class_name", F.coalesce("student_name", F.lit(""))).alias("name"),
    )
    staff = teachers.select(
        F.lit("teacher").alias("identity"),
        F.col("teacher_uid").alias("user_uid"),
        F.col("teacher_name").alias("name"),
    )
    return pupils.unionByName(staff)


def _key_set(keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys. Combining before the shuffle keeps a key repeated millions of times harmless."""
    return keys.select(*on).distinct()


def semi_keys(
    df: DataFrame, keys: DataFrame, on: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose key is in the key frame; an empty frame gives no rows."""
    on = [on] if isinstance(on, str) else list(on)
    rows = left_join(df, _key_set(keys, on), on, "left_semi")
    return rows.select(*columns) if columns else rows


def not_in_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``NOT IN`` over a key frame: rows with a NULL key are dropped, as in SQL.

    NULLs in the key frame are ignored: they stand for no key rather than for an unknown one.
    """
    return left_join(df.where(F.col(on).isNotNull()), _key_set(keys, [on]), [on], "left_anti")


def exists_check(requests: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """The requests with an ``exists`` flag: whether the table has a row of that key, live or not."""
    found = _key_set(table, on).withColumn("exists", F.lit(True))
    flagged = left_join(requests, found, on)
    return flagged.withColumn("exists", F.coalesce("exists", F.lit(False)))
