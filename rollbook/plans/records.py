"""The five record tables, laid over the provided test tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.sources.catalog import Catalog

GIVEN = ("nation", "supplier", "customer", "part", "orders", "lineitem", "events")


@lru_cache(maxsize=8)
def given(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, {"given": {name: f"{sf_dir}/{name}.parquet" for name in GIVEN}})


@lru_cache(maxsize=64)
def given_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table; its schema is read from the files once per session."""
    return given(spark, sf_dir).table(name)


def _day(number: Column) -> Column:
    return F.date_add(F.lit("2020-01-01").cast("date"), number.cast("int"))


def _status(deleted: Column) -> Column:
    return F.when(deleted, 0).otherwise(1)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return given_table(spark, sf_dir, "nation").select(
        key.cast("bigint").alias("class_uid"),
        F.col("n_name").alias("class_name"),
        _status(key % 12 == 11).alias("status"),
        _day(key % 7).alias("created"),
    )


def teachers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("teacher_uid"),
        F.col("s_name").alias("teacher_name"),
        F.lower("s_name").alias("username"),
    )


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return given_table(spark, sf_dir, "customer").select(
        key.alias("student_uid"),
        F.col("c_name").alias("student_name"),
        F.lower("c_name").alias("username"),
        F.when(key % 13 != 0, (16 + key % 10).cast("int")).alias("age"),
        F.col("c_nationkey").cast("bigint").alias("class_uid"),
        _status(key % 20 == 0).alias("status"),
        _day(key % 365).alias("created"),
    )


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return given_table(spark, sf_dir, "part").select(
        key.alias("course_uid"),
        F.col("p_name").alias("course_name"),
        (key % 10).alias("teacher_uid"),
        (F.col("p_size") % 27).cast("bigint").alias("class_uid"),
        _status(key % 20 == 0).alias("status"),
        _day(key % 365).alias("created"),
    )


def score_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_changes_of(
        given_table(spark, sf_dir, "lineitem"), given_table(spark, sf_dir, "orders")
    )


def score_changes_of(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    lines = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.col("l_partkey").alias("course_uid"),
        F.col("o_custkey").alias("student_uid"),
        F.col("l_quantity").alias("score"),
        _status(F.col("l_returnflag") == "R").alias("status"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("seq1"),
        F.col("l_linenumber").alias("seq2"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of every (course, student), as an aggregate that combines before the shuffle."""
    last = F.max(F.struct("ts", "seq1", "seq2", "score", "status"))
    folded = (
        score_changes(spark, sf_dir)
        .groupBy("course_uid", "student_uid")
        .agg(last.alias("last"), F.min("ts").alias("created"))
    )
    return folded.select(
        "course_uid",
        "student_uid",
        F.col("last.score").alias("score"),
        F.col("last.status").alias("status"),
        "created",
        F.col("last.ts").alias("updated"),
    )
