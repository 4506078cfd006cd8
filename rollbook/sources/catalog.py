"""Tables by database and name, and the columns of the five record tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

# Column lists of the record tables; every change feed and state frame uses these names.
RECORD_SCHEMAS = {
    "class": "class_uid string, class_name string, status int, created timestamp, updated timestamp",
    "teacher": "teacher_uid string, teacher_name string, username string",
    "student": (
        "student_uid string, student_name string, username string, age int, class_uid string, "
        "status int, created timestamp, updated timestamp"
    ),
    "course": (
        "course_uid string, course_name string, teacher_uid string, class_uid string, "
        "status int, created timestamp, updated timestamp"
    ),
    "score": (
        "course_uid string, student_uid string, score decimal(10,2), status int, "
        "created timestamp, updated timestamp"
    ),
}


class Catalog:
    """``{database: {table: location}}``.

    A location is a Parquet path, or ``{"format": .., "options": {..}}`` for any other Spark source:
    ``jdbc`` with ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` reads a
    live database in parallel.
    """

    def __init__(
        self,
        spark: SparkSession,
        databases: Mapping[str, Mapping[str, str | Mapping]],
        default: str | None = None,
    ) -> None:
        self.spark = spark
        self.databases = databases
        self.default = default or next(iter(databases))

    def table(self, name: str, db: str | None = None) -> DataFrame:
        db = db or self.default
        if db not in self.databases:
            raise KeyError(f"unknown database {db!r}")
        if name not in self.databases[db]:
            raise KeyError(f"unknown table {name!r} in database {db!r}")
        location = self.databases[db][name]
        if isinstance(location, str):
            return self.spark.read.parquet(location)
        reader = self.spark.read.format(location["format"]).options(**location.get("options", {}))
        if "schema" in location:
            reader = reader.schema(location["schema"])
        return reader.load(location["path"]) if "path" in location else reader.load()

    def scan(
        self,
        name: str,
        columns: Sequence[str] | None = None,
        where: Column | None = None,
        db: str | None = None,
    ) -> DataFrame:
        """``select columns from table where ..``; columns are expressions, all of them by default."""
        return project(self.table(name, db), columns, where)


def project(
    df: DataFrame, columns: Sequence[str] | None = None, where: Column | None = None
) -> DataFrame:
    if where is not None:
        df = df.where(where)
    return df.selectExpr(*columns) if columns else df
