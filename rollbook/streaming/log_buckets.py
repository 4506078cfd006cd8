"""A stream of log lines written into time buckets, each bucket once, when it can take no more lines.

Lines wait in Spark's keyed state on disk until the watermark, the newest moment of earlier micro-batches less the delay, has passed the end of their
bucket; an event-time timer hands them on then. A line that comes after that is kept apart as late, one without a moment as such, and none is left
out. A bucket's lines are dealt over several keys, so a bucket that most lines fall into is no one task's, and they are handed
on one by one, never as a whole. Spark's file sink commits each micro-batch's files at once, so a repeated one leaves no line twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rollbook.sources.sinks import BUCKET_FORMATS, bucket
from rollbook.streaming.arrivals import delay_in_ms, use_keyed_state

# Keys that the lines of one bucket are dealt over.
PARTS = 32
# Lines that go to the state in one call; a call for each line takes longer than all else.
CHUNK = 1000


class Waiting(StatefulProcessor):
    """Keeps the lines of a part of a bucket until the bucket has ended."""

    def __init__(self, schema: T.StructType):
        self.schema, self.names = schema, schema.names
        self.told = Row(*schema.names, "verdict")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        end = key[1]
        if end is None or end <= timerValues.getCurrentWatermarkInMs():
            verdict = "no_ts" if end is None else "late"
            for row in rows:
                yield self.told(*[row[n] for n in self.names], verdict)
        else:
            lines = (tuple(row[n] for n in self.names) for row in rows)
            while chunk := list(islice(lines, CHUNK)):
                self.lines.appendList(chunk)
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        for line in self.lines.get():
            yield self.told(*line, "closed")
        self.lines.clear()

    def close(self) -> None:
        pass


def bucket_lines(lines: DataFrame, ts: str, way: str, delay: str, parts: int = PARTS) -> DataFrame:
    """The lines of a stream with ``verdict``, each once: ``closed`` when its bucket has ended, ``late`` or ``no_ts`` when it comes.

    ``way`` is month, day or hour, any other width counts as a day, as in ``bucket``; ``delay`` is an interval such as ``2 hours``. Lines of buckets
    that have not ended stay in the state for the next run. Equal lines are lines of their own.
    """
    use_keyed_state(lines.sparkSession)
    delay_ms = delay_in_ms(lines.sparkSession, delay)
    names, moment = lines.columns, F.col(ts).cast("timestamp")
    width = way if way in BUCKET_FORMATS else "day"
    end = F.unix_millis(F.date_trunc(width, moment) + F.expr(f"interval 1 {width}"))
    # the watermark follows all moments, and late lines still go on: the column that carries it ends here
    marked = lines.withColumn("_moment", moment).withWatermark("_moment", f"{delay_ms} milliseconds").select(*names)
    keyed = marked.withColumns({"_part": F.pmod(F.xxhash64(*names), F.lit(parts)), "_end": end})
    schema = T.StructType([*lines.schema.fields, T.StructField("verdict", T.StringType())])
    return keyed.groupBy("_part", "_end").transformWithState(Waiting(lines.schema), schema, "Append", "EventTime")


def write_log_buckets(lines: DataFrame, ts: str, way: str, path: str, checkpoint: str, delay: str, parts: int = PARTS) -> StreamingQuery:
    """Write what has arrived to ``path``, a folder for each verdict and bucket; run it again for what arrives later."""
    told = bucket_lines(lines, ts, way, delay, parts).withColumn("bucket", bucket(ts, way))
    sink = told.writeStream.format("parquet").partitionBy("verdict", "bucket").option("checkpointLocation", checkpoint)
    return sink.outputMode("append").trigger(availableNow=True).start(path)


def read_log_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All lines written so far, of ``schema``, with ``verdict`` and ``bucket``. Only files of whole micro-batches are read."""
    more = [T.StructField(c, T.StringType()) for c in ("verdict", "bucket")]
    return spark.read.schema(T.StructType([*schema.fields, *more])).parquet(path)
