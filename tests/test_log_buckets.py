import datetime
import random
import uuid
from collections import Counter

from pyspark.sql import functions as F

from rollbook.sources.sinks import bucket
from rollbook.streaming.log_buckets import read_log_buckets, write_log_buckets

SCHEMA = "ts timestamp_ntz, line string, code int, verdict_of string"
START = datetime.datetime(2024, 2, 28, 22, 10)


def deliver(spark, folder, rows, way="hour", delay="90 minutes", parts=3):
    lines = spark.createDataFrame(rows, SCHEMA)
    lines.coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema(lines.schema).parquet(f"{folder}/log")
    query = write_log_buckets(stream, "ts", way, f"{folder}/buckets", f"{folder}/checkpoint", delay, parts)
    query.awaitTermination()
    return read_log_buckets(spark, f"{folder}/buckets", lines.schema)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def end_of(ts, way="hour"):
    start = ts.replace(minute=0, second=0, microsecond=0)
    if way == "hour":
        return start + datetime.timedelta(hours=1)
    start = start.replace(hour=0)
    return start + datetime.timedelta(days=1) if way == "day" else (start.replace(day=28) + datetime.timedelta(days=4)).replace(day=1)


def test_every_line_is_closed_late_refused_or_still_waiting(spark, tmp_path):
    """Three deliveries out of order, hot buckets, equal lines, no moments; against a model that sees one delivery after another."""
    draw = random.Random(5)
    deliveries, limit, told, waiting = [], None, Counter(), Counter()
    for n in range(3):
        rows = []
        for i in range(150):
            late = draw.random() < 0.2
            minute = 5 if draw.random() < 0.4 else draw.randrange(300)
            ts = None if draw.random() < 0.03 else at(n * 300 + minute - (draw.randrange(600) if late else 0))
            rows.append((ts, None if i % 40 == 0 else f"line {i % 30}", i % 3, f"d{n}"))
        deliveries.append(rows)
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    for rows in deliveries:
        found = deliver(spark, folder, rows)
        for row in rows:
            if row[0] is None:
                told[row, "no_ts"] += 1
            elif limit is not None and end_of(row[0]) <= limit:
                told[row, "late"] += 1
            else:
                waiting[row] += 1
        limit = max([r[0] for r in rows if r[0]] + ([limit + datetime.timedelta(minutes=90)] if limit else [])) - datetime.timedelta(minutes=90)
        for row in [r for r in waiting if end_of(r[0]) <= limit]:
            told[row, "closed"] += waiting.pop(row)
        got = Counter({((r.ts, r.line, r.code, r.verdict_of), r.verdict): n for r, n in Counter(found.collect()).items()})
        assert got == told
    assert {v for _, v in told} == {"closed", "late", "no_ts"} and waiting
    assert sum(told.values()) + sum(waiting.values()) == sum(map(len, deliveries))
    # read back, the closed buckets are what a batch would have put there
    whole = spark.createDataFrame([r for d in deliveries for r in d], SCHEMA).withColumn("b", bucket("ts", "hour"))
    late = sum(n for (r, v), n in told.items() if v == "late")
    closed = found.where("verdict = 'closed'")
    assert closed.where(bucket("ts", "hour") != F.col("bucket")).count() == 0
    assert {r.bucket for r in closed.select("bucket").collect()} <= {r.b for r in whole.collect()}
    per = lambda df, c: Counter(r[c] for r in df.collect())
    batch, done = per(whole.where("b is not null"), "b"), per(closed, "bucket")
    assert sum(batch[b] - done[b] for b in done) + sum(n for b, n in batch.items() if b not in done) == late + sum(waiting.values())


def test_days_months_and_a_run_without_new_lines(spark, tmp_path):
    for way in ("day", "month", "week"):
        width = "month" if way == "month" else "day"
        folder = f"{tmp_path}/{uuid.uuid4().hex}"
        first = [(at(0), "a", 1, "x"), (at(30), "a", 1, "x"), (at(30), "a", 1, "x")]
        assert deliver(spark, folder, first, way, "0 seconds").count() == 0
        found = deliver(spark, folder, [(at(60 * 24 * 40), "b", 1, "x")], way, "0 seconds")
        assert sorted((r.ts, r.verdict) for r in found.collect()) == [(at(0), "closed"), (at(30), "closed"), (at(30), "closed")]
        assert {r.bucket for r in found.collect()} == {"202402" if width == "month" else "20240228"}
        again = deliver(spark, folder, [], way, "0 seconds")
        assert again.count() == 3
        last = deliver(spark, folder, [(at(1), "c", 1, "x")], way, "0 seconds")
        assert [r.line for r in last.where("verdict = 'late'").collect()] == ["c"] and last.count() == 4


def test_lines_wait_in_chunks(spark, tmp_path, monkeypatch):
    """The state is called for chunks of lines, not for each of them."""
    from rollbook.streaming import log_buckets

    class Lines:
        def __init__(self):
            self.calls = []

        def appendList(self, lines):  # noqa: N802
            self.calls.append(lines)

    class Quiet:
        registerTimer = staticmethod(lambda end: None)  # noqa: N815
        getCurrentWatermarkInMs = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(log_buckets, "CHUNK", 4)
    waiting = log_buckets.Waiting(spark.createDataFrame([], SCHEMA).schema)
    waiting.handle, waiting.lines = Quiet, Lines()
    rows = [{"ts": at(i), "line": str(i), "code": i, "verdict_of": None} for i in range(10)]
    assert list(waiting.handleInputRows((0, 10**15), iter(rows), Quiet)) == []
    assert [len(c) for c in waiting.lines.calls] == [4, 4, 2] and sum(waiting.lines.calls, []) == [tuple(r.values()) for r in rows]
