"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rollbook.session import shared_folder

#: Paths of the tables that this program has written, in their order.
WRITTEN: list[str] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once and read it from then on: the rows stay the same however often it is used."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables were written so far."""
    return len(WRITTEN)


def remove(spark: SparkSession, start: int, stop: int | None = None) -> None:
    """Delete the tables written from one mark to another, by default up to now. Call it once nothing reads them any more."""
    for path in filter(None, WRITTEN[start:stop]):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    WRITTEN[start:stop] = [""] * len(WRITTEN[start:stop])


def tables() -> list[str]:
    """Tables that were written and not deleted."""
    return [path for path in WRITTEN if path]
