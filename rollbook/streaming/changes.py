"""A stream of changes folded into a record table, micro-batch by micro-batch.

The table is a folder of Parquet files: ``rows/batch=<n>/bucket=<b>`` holds the rows the n-th micro-batch reached,
as they were after it, and the newest version of a key is its current row; the bucket follows from the key. Within, the
files are those of a table bucketed by key, in as many parts as ``parts/`` tells, so that Spark groups and joins the table by key
without shuffling it; tables begun before there were parts go on without. For records with unique names ``names/batch=<n>/bucket=<b>`` holds the name and key of the same rows, by bucket of the
name. So a micro-batch reads only the buckets of its keys and names, and writes only what it changed, whatever the
size of the table; a retried one reads the same earlier batches and overwrites its own folders.
``rejected/batch=<n>`` holds the refused events and ``repeated/batch=<n>`` those that came again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollbook.operators import folds
from rollbook.streaming.arrivals import judge_arrivals

FIRST_BATCH = -1  # the table as it was before the stream
# Keys of a micro-batch, repetitions included, up to this count are broadcast to the scan of the table.
BROADCAST_KEYS = 1_000_000
# Buckets of a table, of its keys as of its names. It is part of the table's layout, so it stays as it is once there are rows.
BUCKETS = 16
PARTITIONS_IN_CATALOG = "spark.sql.hive.manageFilesourcePartitions"


class Record(NamedTuple):
    """How a record type takes a stream of changes."""

    keys: Sequence[str]
    fold: Callable[[DataFrame, DataFrame], folds.Fold]
    # columns that must stay unique, and the form in which the feed asks for them
    names: Sequence[str] = ()
    asked: Callable[[DataFrame], DataFrame] = lambda feed: feed
    # column the uid of a created row is made from
    named_by: str = ""


def _student_names(feed: DataFrame) -> DataFrame:
    blank = F.coalesce(F.col("username"), F.lit("")) == ""
    return feed.withColumn("username", F.when(blank, F.col("student_name")).otherwise(F.col("username")))


RECORDS = {
    "score": Record(["course_uid", "student_uid"], folds.upsert_scores),
    "student": Record(["student_uid"], folds.upsert_students, ["username"], _student_names, "username"),
    "course": Record(
        ["course_uid"],
        folds.upsert_courses,
        ["teacher_uid", "class_uid", "course_name"],
        named_by="course_name",
    ),
    "class": Record(["class_uid"], folds.upsert_classes, ["class_name"], named_by="class_name"),
}


def _bucket(columns: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in columns]), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, folder: str, by: Sequence[str], batch_id: int) -> None:
    """Write rows by bucket; a bucket with most of them is split over several tasks."""
    marked = rows.withColumn("bucket", _bucket(by)).hint("rebalance", "bucket")
    marked.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={batch_id}")


def _part_bucket(columns: Sequence[str], parts: int) -> Column:
    """The bucket of a row that lies in parts: each part lies in one bucket."""
    return F.pmod(F.pmod(F.hash(*columns), F.lit(parts)), F.lit(BUCKETS))


def _path(spark: SparkSession, folder: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a folder, and its full path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


def _parts(spark: SparkSession, folder: str) -> int | None:
    """In how many parts the rows lie."""
    try:
        return spark.read.schema("parts int").parquet(f"{folder}/parts").first()["parts"]
    except AnalysisException:
        return None


def _write_rows(rows: DataFrame, folder: str, how: Record, batch_id: int, by_key: bool = False) -> None:
    """Write the versions of a micro-batch; rows that a shuffle has laid ``by_key`` into the parts are not shuffled again."""
    spark = rows.sparkSession
    parts = _parts(spark, folder)
    if parts is None:
        _write(rows, f"{folder}/rows", how.keys, batch_id)
    else:
        shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # a task that holds other than whole parts writes a file for each it has rows of
        if not by_key or (shuffled != parts and shuffled * parts > BUCKETS * BUCKETS):
            rows = rows.repartition(parts, *how.keys)
        marked = rows.withColumn("bucket", _part_bucket(how.keys, parts))
        name = f"rollbook_{uuid.uuid4().hex}"
        try:
            writer = marked.write.mode("overwrite").partitionBy("bucket").bucketBy(parts, *how.keys)
            writer.saveAsTable(name, format="parquet", path=_path(spark, f"{folder}/rows/batch={batch_id}")[1].toString())
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay
    if how.names:
        names = list(dict.fromkeys([*how.names, *how.keys]))
        _write(rows.select(*names), f"{folder}/names", how.names, batch_id)


def _versions(spark: SparkSession, folder: str, how: Record) -> DataFrame:
    """All versions of all rows."""
    files = spark.read.parquet(f"{folder}/rows")
    parts = _parts(spark, folder)
    if parts is None:
        return files
    name = f"rollbook_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    keys = ", ".join(f"`{c}`" for c in how.keys)
    place = _path(spark, f"{folder}/rows")[1].toString().replace("\\", "\\\\").replace("'", "\\'")
    managed = spark.conf.get(PARTITIONS_IN_CATALOG, "true")
    spark.conf.set(PARTITIONS_IN_CATALOG, "false")  # the folders tell them
    try:
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (batch, bucket) CLUSTERED BY ({keys}) INTO {parts} BUCKETS "
            f"LOCATION '{place}'"
        )
        return spark.table(name)
    finally:
        spark.conf.set(PARTITIONS_IN_CATALOG, managed)
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the frame has its files


def _begin(spark: SparkSession, folder: str) -> None:
    """Settle the number of parts of a table that has no rows yet: what the session shuffles into, at least one a bucket."""
    system, place = _path(spark, f"{folder}/rows")
    if not system.exists(place):
        parts = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.range(1).select(F.lit(parts).alias("parts")).write.mode("overwrite").parquet(f"{folder}/parts")


def start_table(rows: DataFrame, folder: str, feed: DataFrame, record: str, by_key: bool = False) -> None:
    """Write the rows a stream starts from, ready to take changes shaped like ``feed``.

    Rows that were just grouped by the keys are ``by_key`` already, and not shuffled again.
    """
    _begin(rows.sparkSession, folder)
    _write_rows(folds.with_position(rows, feed), folder, RECORDS[record], FIRST_BATCH, by_key)


def read_table(spark: SparkSession, folder: str, record: str) -> DataFrame:
    """The current rows: the newest version of every key."""
    how = RECORDS[record]
    return _newest(_versions(spark, folder, how), how.keys)


def read_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rejected").drop("batch")


def read_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Events that came again within the delay, as far as a stream was given one."""
    return spark.read.parquet(f"{folder}/repeated").drop("batch")


def _newest(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    fields = [c for c in versions.columns if c not in (*keys, "batch", "bucket")]
    newest = F.max_by(F.struct(*fields), F.col("batch")).alias("_row")
    return versions.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def compact(spark: SparkSession, folder: str, record: str, target: str) -> None:
    """Write the current rows as the start of a new folder, to be used from then on."""
    rows = read_table(spark, folder, record)
    _begin(spark, target)
    _write_rows(rows, target, RECORDS[record], FIRST_BATCH)


def _small(keys: DataFrame) -> DataFrame:
    """The keys, to be broadcast where their count allows it."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _in_buckets(table: DataFrame, keys: DataFrame, on: Sequence[str], bucket: Callable[[Sequence[str]], Column] = _bucket) -> DataFrame:
    """Rows of a bucketed table with one of the keys; only the files of the keys' buckets are read."""
    keys = keys.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in on])
    found = [r[0] for r in keys.select(bucket(on).alias("b")).distinct().collect()]
    return table.where(F.col("bucket").isin(found)).join(_small(keys), list(on), "left_semi")


def _touched(spark: SparkSession, folder: str, feed: DataFrame, record: Record, batch_id: int) -> DataFrame:
    """All versions of the rows the feed may concern: its keys, and whoever holds a name it asks for."""
    earlier = F.col("batch") < batch_id
    keys = feed.select(*record.keys)
    if record.names:
        asked = record.asked(feed)
        created = asked.where(F.col("op") == "create").select(folds.new_uid(record.named_by).alias(record.keys[0]))
        names = spark.read.parquet(f"{folder}/names").where(earlier)
        holders = _in_buckets(names, asked.select(*record.names), record.names).select(*record.keys)
        keys = keys.union(created).union(holders)
    versions = _versions(spark, folder, record).where(earlier)
    parts = _parts(spark, folder)
    return _in_buckets(versions, keys, record.keys, _bucket if parts is None else lambda on: _part_bucket(on, parts))


def _placeable(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with a moment and an id, and the others with the reason they are refused."""
    reason = F.when(F.col("event_id").isNull(), "no_id").when(F.col("ts").isNull(), "no_ts")
    return batch.where(reason.isNull()), batch.where(reason.isNotNull()).select("event_id", "ts", "op", reason.alias("reason"))


def apply_batch(batch: DataFrame, batch_id: int, folder: str, record: str) -> None:
    """Fold one micro-batch into the table.

    Events judged on arrival (``_verdict``) are folded if new, kept apart if repeated and refused otherwise. Those without a moment or an
    id have no place in the order and are refused in any case. So what is folded, refused and repeated is what was delivered.
    """
    how = RECORDS[record]
    batch.persist()
    refused = None
    fresh = batch
    if "_verdict" in batch.columns:
        refused = batch.where("_verdict not in ('new', 'repeat')").select("event_id", "ts", "op", F.col("_verdict").alias("reason"))
        repeated = batch.where("_verdict = 'repeat'").select("event_id", "ts", "op")
        repeated.write.mode("overwrite").parquet(f"{folder}/repeated/batch={batch_id}")
        fresh = batch.where("_verdict = 'new'").drop("_verdict")
    fresh, misplaced = _placeable(fresh)
    refused = misplaced if refused is None else refused.unionByName(misplaced)
    # as many rows as the micro-batch has keys; kept, so that the table is read once
    touched = _touched(batch.sparkSession, folder, fresh, how, batch_id)
    state = _newest(touched, how.keys).persist()
    try:
        result = how.fold(state, fresh)
        _write_rows(result.changed, folder, how, batch_id, by_key=not how.names)
        result.rejected.unionByName(refused).write.mode("overwrite").parquet(f"{folder}/rejected/batch={batch_id}")
    finally:
        state.unpersist()
        batch.unpersist()


def apply_stream(
    changes: DataFrame,
    folder: str,
    checkpoint: str,
    record: str,
    delay: str | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Start folding a stream of changes.

    With a ``delay``, an ``event_id`` seen again within it is kept apart as repeated, and an event that comes later than that behind
    the newest one of earlier micro-batches is refused as ``late`` (see ``arrivals``). Without, a repeated event reaches the fold, where it is
    late to its row and changes nothing; that is all score feeds need. Feeds whose names move between rows should
    set a delay, since a repeated create could otherwise claim a name its row gave up.
    """
    judged = judge_arrivals(changes, delay) if delay else changes
    return (
        judged.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, folder, record))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
