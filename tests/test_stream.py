"""Changes arriving as a stream end at the table one batch would give."""

import re

import pytest
from conftest import tuples
from pyspark.sql import functions as F
from test_folds import FOLDS, feed, random_case, state

from rollbook.operators import folds
from rollbook.streaming import changes as changes_module
from rollbook.streaming.changes import (
    FIRST_BATCH,
    RECORDS,
    _newest,
    _touched,
    _write,
    apply_batch,
    apply_stream,
    compact,
    read_rejected,
    read_repeated,
    read_table,
    start_table,
)


@pytest.mark.parametrize("record", FOLDS)
def test_stream_equals_batch(spark, tmp_path, record):
    rows, events = random_case(record, seed=11)
    start, changes = state(spark, record, *rows), feed(spark, record, *events)
    whole = FOLDS[record](start, changes)
    folder = str(tmp_path / "table")
    start_table(start, folder, changes, record)
    for low, high in ((0, 25), (25, 100)):
        part = changes.where((F.col("event_id") > low) & (F.col("event_id") <= high))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        source = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "feed"))
        query = apply_stream(source, folder, str(tmp_path / "ckpt"), record, delay="10 days")
        query.awaitTermination()
    assert tuples(read_table(spark, folder, record)) == tuples(whole.table)
    refused = {r.event_id for r in whole.rejected.collect()}
    assert {r.event_id for r in read_rejected(spark, folder).collect()} == refused


def test_repeated_events_are_dropped(spark, tmp_path):
    rows, events = random_case("score", seed=2)
    changes = feed(spark, "score", *events)
    folder = str(tmp_path / "table")
    start_table(state(spark, "score", *rows), folder, changes, "score")
    for _ in range(2):
        changes.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    source = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "feed"))
    apply_stream(source, folder, str(tmp_path / "ckpt"), "score", delay="10 days").awaitTermination()
    assert read_rejected(spark, folder).groupBy("event_id").count().where("count > 1").count() == 0


def test_retry_overwrites_itself_and_compaction(spark, tmp_path):
    rows, events = random_case("student", seed=4, moves=False)
    start, changes = state(spark, "student", *rows), feed(spark, "student", *events)
    folder = str(tmp_path / "table")
    start_table(start, folder, changes, "student")
    apply_batch(changes, 0, folder, "student")
    once = tuples(read_table(spark, folder, "student"))
    apply_batch(changes, 0, folder, "student")
    assert tuples(read_table(spark, folder, "student")) == once
    apply_batch(changes, 1, folder, "student")  # a replay changes nothing
    assert tuples(read_table(spark, folder, "student")) == once
    compact(spark, folder, "student", str(tmp_path / "next"))
    assert tuples(read_table(spark, str(tmp_path / "next"), "student")) == once


def test_no_event_vanishes(spark, tmp_path):
    """Each delivered event is applied, refused or a repetition; one beyond the delay is refused as late."""
    start = state(spark, "score", ("c", "s", 1.0, 1))
    changes = feed(spark, "score", *[("patch", "c", "s", float(i)) for i in range(40)])
    folder = str(tmp_path / "table")
    start_table(start, folder, changes, "score")
    deliveries = ["event_id > 30", "event_id = 35 or event_id in (2, 3)", "event_id in (29, 38)"]
    for where in deliveries:
        changes.where(where).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        source = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "feed"))
        apply_stream(source, folder, str(tmp_path / "ckpt"), "score", delay="20 hours").awaitTermination()
    # 29 is within the delay, but late to its row
    assert sorted((r.event_id, r.reason) for r in read_rejected(spark, folder).collect()) == [(2, "late"), (3, "late"), (29, "late")]
    assert tuples(read_table(spark, folder, "score"), "score") == [(39.0,)]


def test_only_buckets_of_touched_keys_and_names_are_read(spark, tmp_path):
    start = state(spark, "class", *[(f"{i}", f"N{i}", 1) for i in range(200)])
    changes = feed(spark, "class", ("rename", "7", "N300"), ("create", None, "N9"))
    folder = str(tmp_path / "table")
    start_table(start, folder, changes, "class")
    touched = _touched(spark, folder, changes, RECORDS["class"], 0)
    assert sorted(r.class_uid for r in touched.collect()) == ["7", "9"]
    plan = touched._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert filters and all("bucket" in f and "batch" in f for f in filters)
    buckets = spark.read.parquet(f"{folder}/rows").select("bucket").distinct().count()
    assert buckets == 16 and all(len(set(re.findall(r"\b\d+\b", f.split("IN")[-1]))) <= 5 for f in filters)


def test_the_table_is_not_shuffled(spark, tmp_path, monkeypatch):
    """However many keys a micro-batch has: only they are shuffled to the table, and the newest versions are found where they lie."""
    start = state(spark, "score", *[(f"c{i}", "s", 1.0, 1) for i in range(200)])
    changes = feed(spark, "score", *[("create", f"c{i}", "s", 2.0) for i in range(100, 300)])
    folder = str(tmp_path / "it's a table")
    start_table(start, folder, changes, "score")
    apply_batch(changes, 0, folder, "score")
    rows = read_table(spark, folder, "score")
    monkeypatch.setattr(changes_module, "BROADCAST_KEYS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        touched = _newest(_touched(spark, folder, changes, RECORDS["score"], 1), ["course_uid", "student_uid"])
        for frame, shuffles in ((rows, 0), (touched, 1)):
            assert frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == shuffles
        assert touched.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tuples(rows, "course_uid", "score") == sorted((f"c{i}", 1.0 if i < 100 else 2.0) for i in range(300))


def test_a_table_begun_without_parts_goes_on(spark, tmp_path):
    rows, events = random_case("score", seed=6)
    start, changes = state(spark, "score", *rows), feed(spark, "score", *events)
    folder = str(tmp_path / "table")
    _write(folds.with_position(start, changes), f"{folder}/rows", RECORDS["score"].keys, FIRST_BATCH)
    apply_batch(changes, 0, folder, "score")
    assert tuples(read_table(spark, folder, "score")) == tuples(FOLDS["score"](start, changes).table)
    compact(spark, folder, "score", str(tmp_path / "next"))
    assert tuples(read_table(spark, str(tmp_path / "next"), "score")) == tuples(read_table(spark, folder, "score"))


@pytest.mark.parametrize("delay", [None, "1 day"])
def test_no_event_is_lost(spark, tmp_path, delay):
    """What is folded, refused and repeated is what was delivered, events without a moment or an id included."""
    start = state(spark, "class", ("1", "N1", 1), ("2", "N2", 1), ("3", "N3", 1))
    made = feed(spark, "class", ("delete", "1", None), ("rename", "2", "N8"), ("create", None, "N9"), ("delete", "3", None), ("create", None, "N7"))
    void = lambda c, *ids: F.when(F.col("event_id").isin(*ids), None).otherwise(F.col(c))
    odd = made.withColumn("ts", void("ts", 2)).withColumn("event_id", void("event_id", 4, 5))
    folder, source = str(tmp_path / "table"), str(tmp_path / "feed")
    start_table(start, folder, odd, "class")
    old = made.where("event_id = 1").withColumns({"ts": F.col("ts") - F.expr("interval 400 days"), "event_id": F.lit(70).cast(made.schema["event_id"].dataType)})
    for part in (odd, odd.where("event_id = 3").unionByName(old)):
        part.coalesce(1).write.mode("append").parquet(source)
        changes = spark.readStream.schema(odd.schema).parquet(source)
        apply_stream(changes, folder, str(tmp_path / "ckpt"), "class", delay=delay).awaitTermination()
    got = {r["class_uid"]: (r["class_name"], r["status"]) for r in read_table(spark, folder, "class").collect()}
    assert got["1"] == ("N1", 0) and got["2"] == ("N2", 1) and got["3"] == ("N3", 1) and len(got) == 4
    assert sorted(r[0] for r in got.values()) == ["N1", "N2", "N3", "N9"]
    refused = sorted((r["reason"], r["event_id"] or 0) for r in read_rejected(spark, folder).collect())
    assert refused == [("late", 3 if delay is None else 70), *([("late", 70)] if delay is None else []), ("no_id", 0), ("no_id", 0), ("no_ts", 2)]
    if delay:
        assert [r["event_id"] for r in read_repeated(spark, folder).collect()] == [3]


def test_random_deliveries_are_conserved(spark, tmp_path):
    rows, events = random_case("student", seed=12)
    changes = feed(spark, "student", *events)
    changes = changes.withColumn("event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_id"))).withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    folder, source = str(tmp_path / "table"), str(tmp_path / "feed")
    start_table(state(spark, "student", *rows), folder, changes, "student")
    delivered = 0
    for part in (changes, changes.where("event_id % 2 = 0"), changes):
        delivered += part.count()
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(changes.schema).parquet(source)
        apply_stream(stream, folder, str(tmp_path / "ckpt"), "student", delay="10 days").awaitTermination()
    refused = read_rejected(spark, folder).where("reason in ('no_id', 'no_ts', 'late')").count()
    ids = {r["event_id"] for r in changes.where("event_id is not null and ts is not null").collect()}
    assert delivered == refused + read_repeated(spark, folder).count() + len(ids)
