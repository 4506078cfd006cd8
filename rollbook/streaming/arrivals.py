"""Which events of a stream are new, repeated or too late, by Spark's keyed state.

Every event id is a key of a state store on disk. It is remembered until the watermark, the newest moment of earlier micro-batches less the
delay, has left it behind by another delay; an event-time timer forgets it then. So the state grows with the events of that time, and no micro-batch
reads what earlier ones brought.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Keys that events without an id are dealt over.
SPREAD = 4096


class Arrivals(StatefulProcessor):
    """Adds a verdict to the events of one id."""

    def __init__(self, names: list[str], delay_ms: int):
        self.names, self.delay_ms = names, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ts timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        known = None
        for row in rows:
            values = row.asDict()
            at = values["_ms"]
            if values["event_id"] is None:
                verdict = "no_id"
            elif at is None:
                verdict = "no_ts"
            elif at < watermark:
                verdict = "late"
            else:
                known = self.seen.exists() if known is None else known
                verdict = "repeat" if known else "new"
                if not known:
                    known = True
                    self.seen.update((datetime.datetime.fromtimestamp(at / 1000),))
                    self.handle.registerTimer(max(at, watermark) + self.delay_ms)
            yield Row(**{n: values[n] for n in self.names}, _verdict=verdict)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    if spark.conf.get(STORE, None) != ROCKS:
        spark.conf.set(STORE, ROCKS)  # the only store that has this kind of state


def delay_in_ms(spark: SparkSession, delay: str) -> int:
    return spark.sql(f"select cast(unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {delay}) as bigint)").first()[0]


def judge_arrivals(changes: DataFrame, delay: str) -> DataFrame:
    """The events of a stream with ``_verdict``: ``new``, ``repeat``, ``late``, ``no_ts`` or ``no_id``. No event is left out.

    ``delay`` is an interval such as ``10 days``. The first event of an id is new, whatever order a micro-batch brings them in.
    """
    use_keyed_state(changes.sparkSession)
    delay_ms = delay_in_ms(changes.sparkSession, delay)
    names = changes.columns
    moment = F.col("ts").cast("timestamp")
    # the watermark follows all moments, and late events still go on: the column that carries it ends here
    marked = changes.withColumn("_moment", moment).withWatermark("_moment", f"{delay_ms} milliseconds").select(*names)
    key = F.coalesce(F.concat(F.lit("id:"), F.col("event_id").cast("string")), F.concat(F.lit("row:"), F.pmod(F.xxhash64(*names), F.lit(SPREAD))))
    keyed = marked.withColumns({"_ms": F.unix_millis(moment), "_key": key})
    schema = T.StructType([*changes.schema.fields, T.StructField("_verdict", T.StringType())])
    return keyed.groupBy("_key").transformWithState(Arrivals(names, delay_ms), schema, "Append", "EventTime")
