"""States and change feeds over the provided test tables.

The states keep string uids, as the record tables do. Some rows have taken events before, so the feeds
also hold late events; names collide on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.plans.records import classes, courses, given_table, score_changes, students

# Changes before this moment make the score state, later ones the feed.
SCORE_CUT = "1998-06-01"
# Rows with a position had their last event at this moment.
APPLIED = "2024-01-10"


def _moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _with_positions(state: DataFrame, number: Column) -> DataFrame:
    """Every third row has taken an event before."""
    old = number % 3 == 0
    return state.withColumns(
        {
            "created": F.col("created").cast("timestamp_ntz"),
            "updated": F.when(old, _moment(APPLIED)),
            "applied_ts": F.when(old, _moment(APPLIED)),
            "applied_id": F.when(old, F.lit(0).cast("bigint")),
        }
    )


def score_events(changes: DataFrame) -> DataFrame:
    """Score changes as events: every third line number corrects, the others record."""
    return changes.select(
        (F.col("seq1") * 1000 + F.col("seq2") * 100 + F.col("score").cast("bigint")).alias("event_id"),
        "ts",
        F.when(F.col("seq2") % 3 == 0, "patch").otherwise("create").alias("op"),
        "course_uid",
        "student_uid",
        "score",
        "status",
    )


def score_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = score_events(score_changes(spark, sf_dir)).where(F.col("ts") < _moment(SCORE_CUT))
    folded = old.groupBy("course_uid", "student_uid").agg(
        F.max(F.struct("ts", "event_id", "score", "status")).alias("last"),
        F.min("ts").alias("created"),
    )
    return folded.select(
        "course_uid",
        "student_uid",
        F.col("last.score").alias("score"),
        F.col("last.status").alias("status"),
        "created",
        F.col("last.ts").alias("updated"),
        F.col("last.ts").alias("applied_ts"),
        F.col("last.event_id").alias("applied_id"),
    )


def score_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = score_events(score_changes(spark, sf_dir))
    return events.where(F.col("ts") >= _moment(SCORE_CUT)).drop("status")


def _numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return given_table(spark, sf_dir, "events").withColumn("k", k)


def _text(column: Column) -> Column:
    return column.cast("string")


def student_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("student_uid")
    state = _with_positions(students(spark, sf_dir), key)
    return state.withColumns({"student_uid": _text(key), "class_uid": _text(F.col("class_uid"))})


def student_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")
    pupil = F.concat(F.lit("pupil"), _text(user % 50), F.lit("_"), _text(k % 20))
    taken = F.concat(F.lit("customer#"), F.lpad(_text(user), 9, "0"))
    create, patch = kind == "signup", kind.isin("click", "purchase")
    return _numbered_events(spark, sf_dir).select(
        "event_id",
        "ts",
        F.when(create, "create")
        .when(patch, "patch")
        .when(kind == "error", "delete")
        .otherwise(kind)
        .alias("op"),
        F.when(~create, _text(user * 11)).alias("student_uid"),
        F.when(create & (k % 10 != 9), F.concat(F.lit("Pupil "), _text(user % 40)))
        .when((kind == "click") & (k % 2 == 0), F.concat(F.lit("Renamed "), _text(k)))
        .otherwise("")
        .alias("student_name"),
        F.when(create & (k % 4 == 1), taken)
        .when(create & (k % 4 > 1), pupil)
        .when((kind == "click") & (k % 5 == 0), pupil)
        .when((kind == "click") & (k % 5 == 1), taken)
        .otherwise("")
        .alias("username"),
        F.when((create | (kind == "purchase")) & (k % 3 > 0), (k % 30).cast("int")).alias("age"),
        F.when(create | (k % 7 == 0), _text(k % 25)).alias("class_uid"),
    )


def course_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("course_uid")
    state = _with_positions(courses(spark, sf_dir), key)
    return state.withColumns(
        {c: _text(F.col(c)) for c in ("course_uid", "teacher_uid", "class_uid")}
    )


def course_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creates of old and new triples, patches and deletes by right and wrong teachers."""
    kind, k, target = F.col("event_type"), F.col("k"), F.col("target")
    create, patch = kind.isin("signup", "error"), kind.isin("click", "view")
    events = _numbered_events(spark, sf_dir).withColumn("target", F.col("user_id") * 10 + k)
    part = given_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    rows = events.join(part, F.col("target") == F.col("p_partkey"), "left")
    other = (kind == "signup") & (k % 2 == 0)
    wrong = ~create & (k % 4 == 0)
    return rows.select(
        "event_id",
        "ts",
        F.when(create, "create").when(patch, "patch").otherwise("delete").alias("op"),
        F.when(~create, _text(target)).alias("course_uid"),
        F.when(wrong, "none").otherwise(_text(target % 10)).alias("teacher_uid"),
        F.when(create & other, F.concat(F.lit("9"), _text(k % 3)))
        .when(create, _text(F.col("p_size") % 27))
        .when(patch & (k % 3 == 0), _text(k % 27))
        .otherwise("")
        .alias("class_uid"),
        F.when(create, F.col("p_name"))
        .when(kind == "click", F.concat(F.lit("patched "), _text(k)))
        .otherwise("")
        .alias("course_name"),
    )


def class_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("class_uid")
    return _with_positions(classes(spark, sf_dir), key).withColumn("class_uid", _text(key))


def class_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")
    return _numbered_events(spark, sf_dir).select(
        "event_id",
        "ts",
        F.when(kind == "signup", "create")
        .when(kind == "click", "rename")
        .when(kind == "error", "delete")
        .otherwise(kind)
        .alias("op"),
        F.when(kind != "signup", _text(user % 30)).alias("class_uid"),
        F.when((kind == "click") & (k % 9 == 0), "")
        .when(kind == "click", F.concat(F.lit("NATION_"), _text((user * 7 + k) % 90)))
        .when(kind == "signup", F.concat(F.lit("NATION_"), _text(k % 40)))
        .alias("class_name"),
    )
