import datetime as dt
from decimal import Decimal

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from rollbook.functions.rendering import render_rows
from rollbook.functions.tokens import expiry_strings, make_token, sign_params, token_audit
from rollbook.session import shared_folder
from rollbook.sources.catalog import RECORD_SCHEMAS, Catalog
from rollbook.sources.request_log import log_line, parse_log, read_log
from rollbook.sources.requests import Param, split_requests, validate_requests
from rollbook.sources.sinks import bucket, write_append, write_buckets


def test_render(spark):
    moment = dt.datetime(2024, 5, 6, 7, 8, 9)
    rows = spark.createDataFrame(
        [
            (1, Decimal("89.90"), moment, None, (Decimal("-89.9"), [moment, None]), {"a": None}),
            (2, None, None, "x", None, None),
        ],
        "id int, d decimal(10,2), t timestamp, s string, "
        "n struct<v: decimal(5,1), l: array<timestamp>>, m map<string, int>",
    )
    got = render_rows(rows, required=["id"]).collect()
    assert got[0].asDict(True) == {
        "id": 1, "d": "89", "t": "2024-05-06", "s": "",
        "n": {"v": "-89", "l": ["2024-05-06", ""]}, "m": {"a": ""},
    }
    assert got[1].asDict(True) == {
        "id": 2, "d": "", "t": "", "s": "x", "n": {"v": "", "l": []}, "m": {}
    }
    kept = render_rows(rows.where("id = 1"), required=["id", "d"])
    assert kept.first().d == 89


def test_token_audit(spark):
    now = 1000
    made = spark.range(1).select(
        make_token(F.lit("student"), F.lit("u1"), F.lit(now), 1, "s").alias("token")
    ).first().token
    forged = made.rsplit(":", 1)[0] + ":x"
    tokens = [made, forged, "student:u1:999:x", "student:u1:5000", "a:b:c:d:e", "student::5000:x",
              "student:u1:soon:x", "", None]
    df = spark.createDataFrame(list(enumerate(tokens)), "id int, token string")
    got = tuples(token_audit(df, now, "s"), "id", "verdict", "digest_ok")
    assert [v for _, *v in got] == [
        ["ok", True], ["ok", False], ["expired", False], ["malformed", False], ["malformed", False],
        ["malformed", False], ["malformed", False], ["malformed", False], ["malformed", False],
    ]
    parts = token_audit(df, now, "s").where("id = 0").first()
    assert (parts.identity, parts.user_uid, parts.expiry) == ("student", "u1", now + 86400)


def test_sign_params(spark):
    import hashlib

    def md5(text):
        return hashlib.md5(text.encode()).hexdigest()

    df = spark.createDataFrame(
        [({"b": "x", "a": "", "c": None, "aa": "Y"}, "t"), ({}, "t")], "p map<string,string>, t string"
    )
    got = [r[0] for r in df.select(sign_params(F.col("p"), F.lit("key"), F.col("t"))).collect()]
    assert got == [md5("t" + md5(",B=X,AA=Y") + "key"), md5("t" + md5("") + "key")]


def test_expiry_and_buckets(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 31, 23, 30), 3600)], "ts timestamp, s int")
    assert tuples(df.select(*expiry_strings(F.col("ts"), F.col("s")))) == [("20241231233000", "20250101003000")]
    ways = [bucket("ts", w) for w in ("month", "day", "hour", "year")]
    assert tuples(df.select(*ways)) == [("202412", "20241231", "2024123123", "20241231")]


PARAMS = [
    Param("k", "int"),
    Param("size", "int", default=20),
    Param("age", "int", required=False),
    Param("kind", "string", required=False, allowed=["a", "b", None]),
    Param("tags", "list", required=False),
]


@pytest.mark.parametrize(
    ("body", "reasons"),
    [
        ('{"k": 1}', []),
        ('{"k": " 12 ", "kind": "a", "tags": []}', []),
        ('{"k": 3.9}', []),
        ('{"k": true, "kind": null}', []),
        ('{"k": "3.9"}', ["k: not an integer"]),
        ('{"k": [1]}', ["k: not an integer"]),
        ('{"k": null}', ["k: required"]),
        ("{}", ["k: required"]),
        ('{"k": 1, "size": "x", "age": "y"}', ["size: not an integer", "age: not an integer"]),
        ('{"k": 1, "kind": "z"}', ["kind: value not allowed"]),
        ('{"k": 1, "kind": 5}', ["kind: wrong type", "kind: value not allowed"]),
        ('{"k": 1, "tags": "t", "x": 1, "b": 2}', ["tags: wrong type", "b: unknown", "x: unknown"]),
        ("[1]", ["malformed"]),
        ('{"k": ', ["malformed"]),
        (None, ["malformed"]),
    ],
)
def test_validate(spark, body, reasons):
    df = spark.createDataFrame([(1, body)], "id int, body string")
    assert validate_requests(df, "body", PARAMS).first().reasons == reasons


def test_validated_values_and_split(spark):
    df = spark.createDataFrame(
        [(1, '{"k": 3.9, "kind": "b"}'), (2, '{"k": " 7 ", "size": "5", "z": 1}')], "id int, body string"
    )
    accepted, rejected = split_requests(validate_requests(df, "body", PARAMS))
    assert tuples(accepted, "id", "k", "size", "kind") == [(1, 3, 20, "b")]
    assert tuples(rejected, "id", "k", "size") == [(2, 7, 5)]
    loose = validate_requests(df, "body", PARAMS, strict=False)
    assert loose.where(F.size("reasons") == 0).count() == 2


def test_request_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(200, "GET", "/a?b=[1]", "", 1.234, 1, "ok", "k=v:x=[y]"),
         (-1000, "OPTIONS", "/c", "u1", 1000.0, -100, "", "")],
        "http int, method string, path string, uid string, ms double, code int, msg string, args string",
    )
    columns = [F.col(c) for c in rows.columns]
    lines = rows.select(log_line(F.lit(7305), *columns).alias("value"))
    text = [r.value for r in lines.collect()]
    assert text[0] == "[7305][ 200]:[ GET]:[/a?b=[1]]::[uid:]:[1.23ms]:[1]:[ok]--[k=v:x=[y]]"
    broken = spark.createDataFrame([("not a log line",), ("",)], "value string")
    lines.union(broken).coalesce(1).write.text(str(tmp_path / "log"))
    good, bad = read_log(spark, str(tmp_path / "log"))
    assert tuples(good, "http_code", "method", "path", "uid", "ms", "code", "msg", "args") == [
        (-1000, "OPTIONS", "/c", "u1", Decimal("1000.00"), -100, "", ""),
        (200, "GET", "/a?b=[1]", "", Decimal("1.23"), 1, "ok", "k=v:x=[y]"),
    ]
    assert tuples(bad) == [("",), ("not a log line",)]
    assert parse_log(spark.createDataFrame([(None,)], "line string")).first().parsed is False


def test_catalog_and_sinks(spark, tmp_path):
    path = str(tmp_path / "student")
    first = spark.createDataFrame([("s1", "Ann")], "student_uid string, student_name string")
    write_append(first, path, first.schema)
    write_append(spark.createDataFrame([("Bob", "s2")], "student_name string, student_uid string"), path)
    for wrong in ("student_uid int, student_name string", "student_uid string, nickname string"):
        with pytest.raises(ValueError):
            write_append(spark.createDataFrame([], wrong), path)
    write_append(spark.createDataFrame([("s0",)], "student_uid string"), path)
    assert tuples(spark.read.parquet(path)) == [("s0", None), ("s1", "Ann"), ("s2", "Bob")]
    first.write.json(str(tmp_path / "json"))
    catalog = Catalog(
        spark,
        {
            "main": {"student": path},
            "other": {"student": {"format": "json", "path": str(tmp_path / "json"),
                                  "schema": "student_uid string"}},
        },
    )
    assert tuples(catalog.scan("student", ["upper(student_name) AS n"], F.col("student_uid") > "s1")) == [("BOB",)]
    assert tuples(catalog.table("student", "other")) == [("s1",)]
    for bad in (("nothing", None), ("student", "nowhere")):
        with pytest.raises(KeyError):
            catalog.table(*bad)
    assert set(RECORD_SCHEMAS) == {"class", "teacher", "student", "course", "score"}


def test_write_buckets(spark, tmp_path):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, h % 24), h) for h in range(48)], "ts timestamp, n int"
    )
    write_buckets(df, "ts", "hour", str(tmp_path / "log"))
    write_buckets(df.limit(1), "ts", "hour", str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 49
    assert back.where("bucket = '2024010105'").count() == 2


def test_shared_folder(spark):
    class Session:
        """A session with just the settings that are read."""

        def __init__(self, folder, master):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = type("Context", (), {"master": master})

    assert shared_folder(spark)
    assert shared_folder(Session("hdfs://shared/place/", "yarn")) == "hdfs://shared/place"
    with pytest.raises(ValueError):
        shared_folder(Session(None, "yarn"))


def test_requests_become_a_feed_and_fold(spark):
    from rollbook.operators.folds import upsert_courses
    from rollbook.sources.change_requests import change_requests

    rows = [
        (1, "POST", "teacher", "t1", '{"course_name": "Art", "class_uid": "c", "more": 1}'),
        (2, "POST", "student", "s1", '{"course_name": "Art", "class_uid": "c"}'),
        (3, "PUT", "teacher", "t2", '{"course_uid": "x", "class_uid": "c"}'),
        (4, "DELETE", "teacher", "t2", '{"course_uid": "x"}'),
        (5, "PATCH", "teacher", "t2", "{}"),
        (6, "POST", None, "t2", "[]"),
    ]
    requests = spark.createDataFrame(
        [(r[0], dt.datetime(2024, 1, 1), *r[1:]) for r in rows],
        "event_id bigint, ts timestamp, method string, identity string, user_uid string, body string",
    )
    feed, rejected = change_requests(requests, "course")
    assert tuples(feed, "event_id", "op", "course_name", "teacher_uid") == [
        (1, "create", "Art", "t1"), (4, "delete", None, "t2")
    ]
    assert [r for _, r in tuples(rejected, "event_id", "reasons")] == [
        ["forbidden"], ["course_name: required"], ["unknown method"], ["malformed", "forbidden"],
    ]
    state = spark.createDataFrame([], RECORD_SCHEMAS["course"])
    fold = upsert_courses(state, feed)
    assert tuples(fold.table, "course_name", "teacher_uid", "status") == [("Art", "t1", 1)]
    assert tuples(fold.rejected, "event_id", "reason") == [(4, "no_match")]

    score = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), "POST", "teacher", "t", '{"course_uid": "c", "student_uid": 5, "score": "89.5"}'),
         (2, dt.datetime(2024, 1, 1), "PUT", "teacher", "t", '{"course_uid": "c", "student_uid": 5, "score": "x"}')],
        requests.schema,
    )
    feed, rejected = change_requests(score, "score")
    assert tuples(feed, "student_uid", "score") == [("5", Decimal("89.50"))]
    assert tuples(rejected, "reasons") == [(["score: not a number"],)]
