"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.ordering import direction
from rollbook.functions.predicates import keyword_filter, where, where_kwargs
from rollbook.functions.rendering import render_rows
from rollbook.functions.tokens import expiry_strings, make_token, sign_params, token_audit
from rollbook.operators import counts, folds, lookup, paging, writes
from rollbook.operators.access import Listing, scoped_read, scoped_rows
from rollbook.operators.aggregation import group_agg as grouped
from rollbook.operators.keyword_search import search_keywords
from rollbook.operators.page_requests import page_requests
from rollbook.operators.joins import left_join
from rollbook.operators.request_filters import match_filters
from rollbook.plans import feeds, records
from rollbook.session import shared_folder
from rollbook.sources.catalog import Catalog
from rollbook.sources.change_requests import change_requests as to_feed
from rollbook.sources.request_log import log_line, parse_log
from rollbook.sources.requests import Param, validate_requests as validate
from rollbook.sources.sinks import BUCKET_FORMATS, append_rows as append, bucket, write_append
from rollbook.streaming.changes import apply_stream, read_table, start_table
from rollbook.streaming.log_buckets import read_log_buckets, write_log_buckets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters the audits take; a real job passes its own.
AUDIT_NOW = 1704567200
AUDIT_SALT = "salt"


def query(function: Query) -> Query:
    """Register under the function's name; ``_job`` only keeps it apart from the operator it calls."""
    QUERIES[function.__name__.removesuffix("_job")] = function
    return function


# --- scans, filters ---------------------------------------------------------------------------


@query
def scan_student(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = records.given(spark, sf_dir)
    return catalog.scan(
        "customer",
        ["c_custkey AS student_uid", "c_name AS student_name", "lower(c_name) AS username"],
    )


@query
def choose_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table name in two databases, told apart by the database's key."""
    folder = f"{sf_dir}/{{}}.parquet"
    catalog = Catalog(spark, {"users": {"person": folder.format("customer")}, "staff": {"person": {"format": "parquet", "path": folder.format("supplier")}}})
    pupils = catalog.scan("person", ["'users' AS db", "c_custkey AS uid", "c_name AS name"])
    return pupils.unionByName(catalog.scan("person", ["'staff' AS db", "s_suppkey AS uid", "s_name AS name"], db="staff"))


@query
def filter_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = [("age", 18, ">=", "and"), ("age", 24, "<", "and"), ("class_uid", 7, "!=", "and"),
             ("student_name", "9", "not like", "and"), ("username", "[0-7]$", "regexp", "and"), ("status", 1, "<=>", "and")]
    return records.students(spark, sf_dir).where(where(items))


@query
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.courses(spark, sf_dir).where(where([("class_uid", [1, 3, 26], "in", "and"), ("course_uid", "(class_uid, 5)", "not in", "and")]))


@query
def filter_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once with a literal list, once with the keys of another frame."""
    students = records.students(spark, sf_dir).where(where([("age", [17, 19], "not in", "and")]))
    deleted = records.classes(spark, sf_dir).where(F.col("status") == 0)
    return lookup.not_in_keys(students, deleted, "class_uid").select(*students.columns)


@query
def filter_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.scores(spark, sf_dir).where(where([("score", [10, 20], "between", "and")]))


@query
def filter_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = [
        ("class_uid", 3, "=", "or"),
        ("age", 20, ">", "and"),
        ("", [("student_name", "1", "like", "or"), ("status", 0, "=", "and")], "sub", "and"),
    ]
    return records.students(spark, sf_dir).where(where(items))


@query
def filter_kwargs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = where_kwargs(class_uid_list=[1, 2, 3], age=None, teacher_uid_list=[], status=1)
    return records.students(spark, sf_dir).where(chosen)


@query
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = F.col("status") == 1
    return records.courses(spark, sf_dir).where(live & keyword_filter("w _ d", ["course_name"]))


@query
def keyword_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = where_kwargs(keyword="r#0%1", match_range=["student_name", "username"], status=1)
    return records.students(spark, sf_dir).where(chosen)


@query
def scoped_read_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    resource = (
        F.when(F.col("event_type") == "click", "course")
        .when(F.col("event_type") == "view", "own_score")
        .when(F.col("event_type") == "signup", "course_score")
        .when(F.col("event_type") == "error", "class")
        .otherwise("grades")
    )
    requests = records.given_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 2 == 0, "student").otherwise("teacher").alias("identity"),
        F.col("user_id").alias("user_uid"),
        resource.alias("resource"),
    )
    scores = records.scores(spark, sf_dir)
    tables = {
        "course": records.courses(spark, sf_dir),
        "own_score": scores,
        "course_score": scores,
        "class": records.classes(spark, sf_dir),
    }
    return scoped_read(requests, tables)



def _page_params() -> list[Column]:
    """Pages, sizes and directions as events may ask for them, some of them impossible."""
    user = F.col("user_id")
    way = F.when(user % 3 == 0, "DESC").when(user % 3 == 1, "asc").when(user % 7 == 2, "up")
    return [(user % 4).alias("page"), (F.col("event_id") % 9 + 2).alias("size"), way.alias("direction")]


def _scoped_rows(spark: SparkSession, sf_dir: str):
    kind = F.col("event_type")
    resource = F.when(kind == "click", "course").when(kind == "view", "own_score").when(kind == "error", "class").otherwise("grades")
    requests = records.given_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 2 == 0, "student").otherwise("teacher").alias("identity"),
        F.col("user_id").alias("user_uid"), resource.alias("resource"), *_page_params(),
    )
    listings = {
        "course": Listing(records.courses(spark, sf_dir), ["course_uid", "course_name"], "created", "course_uid"),
        "own_score": Listing(records.scores(spark, sf_dir), ["course_uid", "score"], "score", "course_uid"),
        "class": Listing(records.classes(spark, sf_dir), ["class_uid", "class_name"], "created", "class_uid"),
    }
    return scoped_rows(requests, listings)


@query
def scoped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request may see of its page, whatever the resource."""
    pages = _scoped_rows(spark, sf_dir).pages
    shown = {"course": ("course_uid", "course_name"), "own_score": ("course_uid", F.col("score").cast("bigint").cast("string")), "class": ("class_uid", "class_name")}
    rows = [pages[r].rows.select("request_id", F.lit(r).alias("resource"), "pos", F.col(uid).alias("uid"), F.col(v).alias("value") if isinstance(v, str) else v.alias("value")) for r, (uid, v) in shown.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def scoped_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped_rows(spark, sf_dir).refused


# --- listings, counts, groups -------------------------------------------------------------------


@query
def pages_course_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = paging.listing(
        records.scores(spark, sf_dir),
        ["course_uid"],
        ["student_uid", "score"],
        ("score", direction("DESC")),
        "student_uid",
        made=True,
    )
    return lookup.lookup(paged, records.students(spark, sf_dir), "student_uid", "student_name")


@query
def pages_hot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same listing with every course of more than 25 scores cut into pieces."""
    return paging.listing(
        records.scores(spark, sf_dir),
        ["course_uid"],
        ["student_uid", "score"],
        ("score", "desc"),
        "student_uid",
        hot_rows=25,
        made=True,
    )


def _page_requests(spark: SparkSession, sf_dir: str):
    requests = records.given_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), (F.col("event_id") * F.col("user_id") % 1500).alias("course_uid"), *_page_params()
    )
    return page_requests(requests, records.scores(spark, sf_dir), ["course_uid"], ["student_uid", "score"], "score", "student_uid")


@query
def requested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request an event, each for a page of one course."""
    return _page_requests(spark, sf_dir).rows


@query
def requested_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_requests(spark, sf_dir).totals


@query
def rejected_page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_requests(spark, sf_dir).rejected


@query
def keyword_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of course names as keywords, some with wildcards, against all live courses: how many each finds, and the first."""
    name, size = F.col("p_name"), F.col("p_size")
    part = F.substring(name, size % 6 + 1, size % 7 + 1)
    word = F.when(size % 5 == 0, F.translate(part, "ae", "__")).when(size % 11 == 0, F.concat(F.substring(name, 1, 2), F.lit("%"), F.substring(name, -2, 2))).otherwise(part)
    keywords = records.given_table(spark, sf_dir, "part").select(word.alias("keyword"))
    live = records.courses(spark, sf_dir).where(F.col("status") == 1)
    found = search_keywords(keywords, live, "course_uid", ["course_name"])
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("matches"), F.min("course_uid").alias("first_uid"))


def _filter_requests(spark: SparkSession, sf_dir: str):
    """One filter an event over the students: by class, ages, status, part of a name; some ask for a column there is not."""
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    one = lambda value: F.array(value.cast("string"))
    ages = F.array((16 + event % 10).cast("string"), (16 + user % 7).cast("string"))
    entries = F.array(
        F.struct(F.lit("class_uid"), F.when(kind != "signup", one(user % 26))),
        F.struct(F.lit("age_list"), F.when(kind == "click", ages)),
        F.struct(F.lit("status"), F.when(kind.isin("click", "view"), one(F.lit(1)))),
        F.struct(F.lit("grade"), F.when((kind == "error") & (user % 10 == 0), one(user))),
    )
    unknown = F.map_filter(F.map_from_entries(entries), lambda k, v: v.isNotNull())
    filters = records.given_table(spark, sf_dir, "events").select(
        event.alias("filter_id"), unknown.alias("terms"), F.when(kind.isin("view", "signup"), (user % 20).cast("string")).alias("keyword"),
        F.when(kind == "view", F.array(F.lit("student_name"), F.lit("username"))).when(kind == "signup", F.array(F.lit("username"))).alias("match_range"),
    )
    return match_filters(filters, records.students(spark, sf_dir), "student_uid", ["class_uid", "age", "status", "student_name", "username"])


@query
def filters_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many students each request's own filter chooses."""
    return _filter_requests(spark, sf_dir).counts


@query
def filters_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many filters choose each student, and the first and last of them."""
    return _filter_requests(spark, sf_dir).chosen


@query
def filters_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filter_requests(spark, sf_dir).rejected


@query
def live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live scores per course after the score feed, from the counts before it and the rows it reached."""
    state = feeds.score_state(spark, sf_dir)
    changed = _scores(spark, sf_dir).changed
    keys = ["course_uid", "student_uid"]
    before = left_join(state, changed.select(*keys), keys, "left_semi")
    return counts.update_counts(paging.count_active(state, ["course_uid"]), before, changed, ["course_uid"])


@query
def pages_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.listing(
        records.students(spark, sf_dir),
        ["class_uid"],
        ["student_uid", "student_name", "age", "username"],
        ("created", "desc"),
        "student_uid",
        keyword="# 0",
        keyword_columns=["student_name"],
    )


@query
def pages_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = paging.listing(
        records.courses(spark, sf_dir),
        ["teacher_uid"],
        ["course_uid", "course_name", "class_uid"],
        ("created", "desc"),
        "course_uid",
    )
    return lookup.lookup(paged, records.classes(spark, sf_dir), "class_uid", "class_name")


@query
def pages_student_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = paging.listing(
        records.scores(spark, sf_dir),
        ["student_uid"],
        ["course_uid", "score"],
        ("created", "desc"),
        "course_uid",
    )
    return lookup.lookup(paged, records.courses(spark, sf_dir), "course_uid", "course_name")


@query
def pages_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.listing(
        records.classes(spark, sf_dir),
        [],
        ["class_uid", "class_name"],
        ("created", "desc"),
        "class_uid",
        size=10,
    )


@query
def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.query(
        records.students(spark, sf_dir),
        {"class_uid_list": [1, 2, 3, 4], "status": 1},
        ["student_uid", "student_name", "age"],
        [("age", "asc"), ("created", "desc"), ("student_uid", "asc")],
        page=2,
        per_page=20,
    )


@query
def key_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page without a given order: the key orders it."""
    return paging.query(records.students(spark, sf_dir), {"status": 1}, ["student_uid", "username"], page=3, per_page=25)


@query
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page beyond the rows that one place may gather, so they are numbered in a distributed way; its order is text."""
    return paging.query(
        records.score_changes(spark, sf_dir),
        {},
        ["course_uid", "student_uid", "score", "seq1", "seq2"],
        "ts DESC, abs(score - 25)",
        page=7,
        per_page=500,
        key=["seq1", "seq2"],
        top_rows=1000,
    )


@query
def first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.first_row(
        records.students(spark, sf_dir),
        ["class_uid"],
        ["created", "student_uid"],
        ["student_uid", "student_name", "created"],
    )


@query
def count_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.count_active(records.students(spark, sf_dir), ["class_uid"])


@query
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = records.scores(spark, sf_dir).where(where_kwargs(status=1))
    return paging.page_counts(live, ["course_uid"], 20)


@query
def query_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.query_counts(records.courses(spark, sf_dir), {"status": 1, "class_uid": 5}, 7)


@query
def group_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(
        records.students(spark, sf_dir),
        "class_uid, status",
        ["count(*) AS students", "avg(age) AS mean_age", "max(created) AS newest"],
    )


@query
def group_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(
        records.scores(spark, sf_dir),
        ["course_uid"],
        ["count(*) AS scores", "max(score) AS best"],
        having="scores >= 30 AND best = 50",
    )


# --- lookups ------------------------------------------------------------------------------------


@query
def lookup_course_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    courses = records.courses(spark, sf_dir).select("course_uid", "course_name", "class_uid")
    return lookup.lookup(courses, records.classes(spark, sf_dir), "class_uid", "class_name")


@query
def lookup_score_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = records.scores(spark, sf_dir).select("student_uid", "course_uid", "score")
    return lookup.lookup(scores, records.courses(spark, sf_dir), "course_uid", "course_name")


@query
def lookup_score_student(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = records.scores(spark, sf_dir).select("course_uid", "student_uid", "score")
    return lookup.lookup(scores, records.students(spark, sf_dir), "student_uid", "student_name")


@query
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    students = records.students(spark, sf_dir).withColumn(
        "class_uid", F.when(F.col("student_uid") % 9 != 0, F.col("class_uid"))
    )
    return lookup.profiles(
        students, records.teachers(spark, sf_dir), records.classes(spark, sf_dir)
    )


@query
def semi_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = records.scores(spark, sf_dir).where(F.col("score") >= 49)
    courses = records.courses(spark, sf_dir)
    return lookup.semi_keys(courses, best, "course_uid", ["course_uid", "course_name"])


@query
def exists_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = records.given_table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_id") % 2500).alias("course_uid"),
        F.col("user_id").alias("student_uid"),
    )
    return lookup.exists_check(
        requests, records.scores(spark, sf_dir), ["course_uid", "student_uid"]
    )


# --- writes -------------------------------------------------------------------------------------


@query
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    students = records.students(spark, sf_dir)
    new = records.teachers(spark, sf_dir).select(
        F.col("username"),
        F.col("teacher_name").alias("student_name"),
        (F.col("teacher_uid") + 1_000_000_000).alias("student_uid"),
        F.lit(1).alias("status"),
    )
    return append(students, new)


@query
def append_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students written as a table, teachers appended to it, and all of it read back."""
    path = f"{shared_folder(spark)}/rollbook-append-{uuid.uuid4().hex}"
    students = records.students(spark, sf_dir)
    write_append(students, path, students.schema)
    new = records.teachers(spark, sf_dir).select(
        F.col("username"),
        F.col("teacher_name").alias("student_name"),
        (F.col("teacher_uid") + 1_000_000_000).alias("student_uid"),
        F.lit(1).alias("status"),
    )
    write_append(new, path)
    return spark.read.parquet(path)


@query
def upsert_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    students = records.students(spark, sf_dir).select(
        "student_uid", "student_name", "age", "status",
        F.col("created").cast("timestamp_ntz").alias("updated"),
    )
    rows = records.given_table(spark, sf_dir, "events").select(
        (F.col("user_id") * 11).alias("student_uid"),
        F.concat(F.lit("New "), F.col("event_type")).alias("student_name"),
        (F.col("event_id") % 30).cast("int").alias("age"),
        F.lit(1).alias("status"),
        "ts",
        "event_id",
    )
    update = {"age": F.col("age"), "updated": "now()", "status": 2}
    return writes.upsert_explicit(students, rows, ["student_uid"], update, ["ts", "event_id"])


@query
def patch_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = where_kwargs(class_uid_list=[1, 5, 9], status=1)
    values = {"class_uid": 2, "age": F.col("age") + 1}
    return writes.patch_update(records.students(spark, sf_dir), matched, values)


@query
def affected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = records.given_table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 30).alias("class_uid"),
        (F.col("event_id") % 2).cast("int").alias("status"),
    )
    return writes.affected_counts(updates, records.students(spark, sf_dir), ["class_uid", "status"])


@query
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = _soft_delete(spark, sf_dir)
    return kept


@query
def soft_delete_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, missed = _soft_delete(spark, sf_dir)
    return missed


def _soft_delete(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    deletes = records.given_table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    deletes = deletes.select(
        (F.col("user_id") * 17).alias("course_uid"), (F.col("user_id") % 10).alias("teacher_uid"), "ts"
    )
    courses = records.courses(spark, sf_dir).withColumn(
        "updated", F.lit(None).cast("timestamp_ntz")
    )
    return writes.soft_delete(courses, deletes, ["course_uid", "teacher_uid"])


def _scores(spark: SparkSession, sf_dir: str) -> folds.Fold:
    return folds.upsert_scores(feeds.score_state(spark, sf_dir), feeds.score_feed(spark, sf_dir))


def _students(spark: SparkSession, sf_dir: str) -> folds.Fold:
    return folds.upsert_students(
        feeds.student_state(spark, sf_dir), feeds.student_feed(spark, sf_dir)
    )


def _courses(spark: SparkSession, sf_dir: str) -> folds.Fold:
    return folds.upsert_courses(feeds.course_state(spark, sf_dir), feeds.course_feed(spark, sf_dir))


def _classes(spark: SparkSession, sf_dir: str) -> folds.Fold:
    return folds.upsert_classes(feeds.class_state(spark, sf_dir), feeds.class_feed(spark, sf_dir))


@query
def upsert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).table


@query
def upsert_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _students(spark, sf_dir).table


@query
def upsert_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _courses(spark, sf_dir).table


@query
def upsert_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).table


@query
def rejected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).rejected


@query
def rejected_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _students(spark, sf_dir).rejected


@query
def rejected_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _courses(spark, sf_dir).rejected


@query
def rejected_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).rejected


@query
def rename_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    renames = feeds.class_feed(spark, sf_dir).where(F.col("op") == "rename").drop("op")
    state = feeds.class_state(spark, sf_dir).drop("applied_ts", "applied_id")
    return folds.rename_verdicts(state, renames)


# --- jobs ---------------------------------------------------------------------------------------


@query
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    kind = F.concat(F.lit(', "kind": "'), F.col("event_type"), F.lit('"}'))
    case = F.col("event_id") % 8
    body = (
        F.when(case < 2, F.concat(F.lit('{"k": '), k, kind))
        .when(case == 2, F.concat(F.lit('{"k": "'), k, F.lit('"'), kind))
        .when(case == 3, F.concat(F.lit('{"k": "x'), k, F.lit('"'), kind))
        .when(case == 4, F.concat(F.lit('{"zz": 1, "k": '), k, kind))
        .when(case == 5, "{}")
        .when(case == 6, F.concat(F.lit('{"k": '), k))
        .otherwise(F.concat(F.lit('{"k": '), k, F.lit('.7, "kind": 5}')))
    )
    params = [
        Param("k", "int"),
        Param("kind", "string", allowed=["signup", "purchase", "click"]),
    ]
    requests = records.given_table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    checked = validate(requests, "body", params)
    return checked.select(
        "event_id", "k", "kind", F.array_join("reasons", "; ").alias("reasons")
    )


def _student_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.student_feed(spark, sf_dir)
    method = (
        F.when(F.col("op") == "create", "POST")
        .when(F.col("op") == "patch", "PUT")
        .when(F.col("op") == "delete", "DELETE")
        .otherwise("HEAD")
    )
    number = F.when(F.col("event_id") % 17 == 0, "many").otherwise(F.col("age").cast("string"))
    body = F.to_json(
        F.struct("student_uid", "student_name", "username", number.alias("age"), "class_uid")
    )
    # absent and null differ: every 19th body says null for the class, to_json leaves other NULLs out
    null = F.regexp_replace(F.regexp_replace(body, ',?"class_uid":"[^"]*"', ""), r"\}$", ',"class_uid":null}')
    body = F.when(F.col("event_id") % 19 == 0, null).otherwise(body)
    body = F.when(F.col("event_id") % 13 == 0, F.substring(body, 1, 15)).otherwise(body)
    identity = F.when(F.col("event_id") % 10 == 0, "student").otherwise("teacher")
    return feed.select(
        "event_id",
        "ts",
        method.alias("method"),
        identity.alias("identity"),
        F.lit("t").alias("user_uid"),
        body.alias("body"),
    )


@query
def change_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, _ = to_feed(_student_requests(spark, sf_dir), "student")
    return feed


@query
def rejected_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = to_feed(_student_requests(spark, sf_dir), "student")
    return rejected.withColumn("reasons", F.array_join("reasons", "; "))


@query
def render_rows_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    students = records.students(spark, sf_dir)
    rows = students.select(
        "student_uid",
        "age",
        "created",
        F.when(F.col("status") == 1, F.col("username")).alias("username"),
        (F.col("student_uid") / 7 - 50).cast("decimal(12,3)").alias("balance"),
        F.struct(
            (F.col("student_uid") / -3).cast("decimal(12,2)").alias("credit"),
            F.col("created").cast("timestamp_ntz").alias("since"),
            F.array("age", "status").alias("marks"),
        ).alias("detail"),
    )
    rendered = render_rows(rows, required=["student_uid", "balance"])
    return rendered.select(
        "student_uid", "age", "created", "username", "balance", "detail.credit", "detail.since",
        F.array_join("detail.marks", ",").alias("marks"),
    )



@query
def token_audit_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = records.given_table(spark, sf_dir, "events")
    identity = F.when(F.col("event_id") % 2 == 0, "student").otherwise("teacher")
    made = make_token(
        identity, F.col("user_id"), F.lit(1704067200) + F.col("event_id") * 100, 0, AUDIT_SALT
    )
    forged = F.regexp_replace(made, ":[^:]*$", ":bad")
    token = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("student:"), F.col("user_id").cast("string")))
        .when(F.col("event_id") % 5 == 0, forged)
        .otherwise(made)
    )
    return token_audit(events.select("event_id", token.alias("token")), AUDIT_NOW, AUDIT_SALT)



@query
def sign_params_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.get_json_object("props", "$.k")
    params = F.create_map(
        F.lit("kind"), F.col("event_type"),
        F.lit("user"), F.col("user_id").cast("string"),
        F.lit("number"), F.when(F.col("event_id") % 3 > 0, number),
        F.lit("Zone"), F.when(F.col("event_id") % 4 > 0, F.lit("north")).otherwise(""),
    )
    stime = F.concat(F.lit("1704067200"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"))
    signature = sign_params(params, F.lit("internal"), stime)
    return records.given_table(spark, sf_dir, "events").select(
        "event_id", signature.alias("signature")
    )



@query
def expiry_strings_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, later = expiry_strings(F.col("ts"), F.col("event_id") % 5000 * 60)
    return records.given_table(spark, sf_dir, "events").select(
        "event_id", now.alias("now_str"), later.alias("expire_str")
    )



def _event_line() -> Column:
    """An event as a line of the request log; some lines are cut short."""
    code = F.when(F.col("event_type") == "error", -100).otherwise(200)
    line = log_line(
        F.lit(7305),
        code,
        F.when(F.col("event_id") % 2 == 0, "GET").otherwise("DELETE"),
        F.concat(F.lit("/"), F.col("event_type")),
        F.col("user_id"),
        F.col("value"),
        F.lit(1),
        F.lit("success"),
        F.concat(F.lit("uid="), F.col("user_id").cast("string")),
    )
    return F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 20)).otherwise(line)


@query
def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = records.given_table(spark, sf_dir, "events")
    parsed = parse_log(events.select("event_id", _event_line().alias("line")))
    return parsed.withColumn("ms", F.col("ms").cast("double"))


@query
def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log delivered in three parts, some lines a part too late and some without a moment, in daily buckets that closed."""
    folder = f"{shared_folder(spark)}/rollbook-log-{uuid.uuid4().hex}"
    part = F.when(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"), 1).when(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"), 2).otherwise(3)
    part = F.least(part + F.when(F.col("event_id") % 25 == 0, 1).otherwise(0), F.lit(3))
    moment = F.when(F.col("event_id") % 997 != 0, F.col("ts"))
    log = records.given_table(spark, sf_dir, "events").select(part.alias("part"), moment.alias("ts"), _event_line().alias("line"))
    for i in (1, 2, 3):
        delivery = log.where(F.col("part") == i).drop("part")
        delivery.write.mode("append").parquet(f"{folder}/log")
        lines = spark.readStream.schema(delivery.schema).parquet(f"{folder}/log")
        write_log_buckets(lines, "ts", "day", f"{folder}/buckets", f"{folder}/checkpoint", "36 hours").awaitTermination()
    found = parse_log(read_log_buckets(spark, f"{folder}/buckets", delivery.schema))
    return found.groupBy("verdict", "bucket").agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("http_code") == -100, 1)).alias("errors"), F.sum(F.length("line")).alias("signs")
    )


@query
def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = F.explode(
        F.array(
            *[F.struct(F.lit(w).alias("way"), bucket("ts", w).alias("bucket")) for w in BUCKET_FORMATS]
        )
    )
    marked = records.given_table(spark, sf_dir, "events").select(ways.alias("b"), "value")
    return marked.groupBy("b.way", "b.bucket").agg(F.count(F.lit(1)).alias("rows"))


# --- stream -------------------------------------------------------------------------------------

# Moments that cut the score feed into the deliveries the stream takes one after another.
DELIVERIES = ["1999-03-01", "2000-01-01", "9999-01-01"]


@query
def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score feed delivered in three parts to a running table; the table after the last one."""
    folder = f"{shared_folder(spark)}/rollbook-stream-{uuid.uuid4().hex}"
    feed = feeds.score_feed(spark, sf_dir)
    start_table(feeds.score_state(spark, sf_dir), f"{folder}/score", feed, "score", by_key=True)
    since = feeds.SCORE_CUT
    for until in DELIVERIES:
        delivery = feed.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
        delivery = delivery.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
        delivery.write.mode("append").parquet(f"{folder}/feed")
        changes = spark.readStream.schema(feed.schema).parquet(f"{folder}/feed")
        stream = apply_stream(changes, f"{folder}/score", f"{folder}/checkpoint", "score")
        stream.awaitTermination()
        since = until
    return read_table(spark, f"{folder}/score", "score")
