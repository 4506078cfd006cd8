"""The join by key that lookups, key sets and feeds share."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPREAD = 4096


def left_join(df: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join that keeps the left side whole (``left``, ``left_semi``, ``left_anti``), ready for skew.

    ``right`` has few rows per key. Both sides get a ``_place`` next to the key:

    * Left rows without a key match nothing, yet a plain join would send all of them to the task of
      the NULL key; their place spreads them. It follows from the row itself, so a repeated task sends
      it the same way.
    * Everywhere else the place is 0, and it makes Spark shuffle the right side for this join alone.
      The runtime skew join splits a hot left key only where both sides come straight from a shuffle,
      which a right side just grouped by the same key would not.
    """
    on = list(on)
    keyless = reduce(operator.or_, [F.col(c).isNull() for c in on])
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    place = F.pmod(F.xxhash64(*[F.col(c) for c in plain]), F.lit(SPREAD)) + 1
    left = df.withColumn("_place", F.when(keyless, place).otherwise(F.lit(0).cast("bigint")))
    # always 0, but not a constant: a constant would be folded out of the join key
    right = right.withColumn("_place", F.pmod(F.xxhash64(*on), F.lit(1).cast("bigint")))
    return left.join(right, [*on, "_place"], how).drop("_place")
