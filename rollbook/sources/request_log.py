"""The request log: one text line per request, written and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The layout of a log line and the type of each of its parts.
LINE = (
    r"^\[(\d+)\]\[ *(-?\d+)\]:\[ *(\S+)\]:\[(.*?)\]::\[uid:(.*?)\]:\[(\d+\.\d\d)ms\]:"
    r"\[(-?\d+)\]:\[(.*?)\]--\[(.*)\]$"
)
PARTS = {
    "port": "int",
    "http_code": "int",
    "method": "string",
    "path": "string",
    "uid": "string",
    "ms": "decimal(18,2)",
    "code": "int",
    "msg": "string",
    "args": "string",
}
# Stands between the parts while a line is taken apart; log text has no such control character.
MARK = "\u0001"


def log_line(
    port: Column,
    http_code: Column,
    method: Column,
    path: Column,
    uid: Column,
    ms: Column,
    code: Column,
    msg: Column,
    args: Column,
) -> Column:
    """A log line; status and method are right-aligned to four characters."""

    def aligned(c: Column) -> Column:
        text = c.cast("string")
        return F.when(F.length(text) >= 4, text).otherwise(F.lpad(text, 4, " "))

    return F.concat(
        F.lit("["), port.cast("string"), F.lit("]["), aligned(http_code), F.lit("]:["),
        aligned(method), F.lit("]:["), path, F.lit("]::[uid:"), uid.cast("string"), F.lit("]:["),
        ms.cast("decimal(18,2)").cast("string"), F.lit("ms]:["), code.cast("string"), F.lit("]:["),
        msg, F.lit("]--["), args, F.lit("]"),
    )


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed columns of each line, next to the line itself.

    One pass of the pattern per line. ``parsed`` is false for lines that do not fit; their columns are
    NULL and the text is kept.
    """
    marked = F.regexp_replace(F.col(line), LINE, MARK.join(f"${i + 1}" for i in range(len(PARTS))))
    parts = F.split(marked, MARK, -1)
    df = lines.withColumn("_parts", parts).withColumn(
        "parsed", F.coalesce(F.size("_parts") == len(PARTS), F.lit(False))
    )
    columns = {
        name: F.when(F.col("parsed"), F.get(F.col("_parts"), F.lit(i))).try_cast(kind)
        for i, (name, kind) in enumerate(PARTS.items())
    }
    return df.withColumns(columns).drop("_parts")


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Log files as (typed rows, lines that could not be read)."""
    rows = parse_log(spark.read.text(path).withColumnRenamed("value", "line"))
    return rows.where("parsed").drop("line", "parsed"), rows.where("not parsed").select("line")
