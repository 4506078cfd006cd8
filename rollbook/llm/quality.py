"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and bigrams are hashed into buckets, and two bags of buckets are fitted: one on all documents, one on a
bounded sample of those labelled good. A document's log importance is the sum of its buckets' log ratios over the
square root of their number: how far it leans to the target, in units of chance, whatever its length. Gumbel noise
that follows from the id is added and the ``k`` largest are kept: a sample without replacement by importance.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import keep, read, slices, text_map

BUCKETS = 1 << 16
#: Labelled documents used at most, chosen by a hash of the id: three in four fit the target, the others set ``k``.
LABELLED_ROWS = 40_000
#: Weight of the Gumbel noise against log importance.
NOISE = 1.0
SMOOTH = 1.0
#: Hashes of words that a task holds at a time.
SEEN_WORDS = 500_000
#: Steps of a sort key in one unit of importance, for an exact selection by counts.
STEPS = 1 << 20

TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hashes(dict):
    """Hash of each token; a word in capitals shares one more token, see ``tokens``."""

    def __missing__(self, token: str) -> int:
        if len(self) >= SEEN_WORDS:
            self.clear()
        value = self[token] = zlib.crc32(token.lower().encode("utf-8", "surrogatepass"))
        return value


SAME = zlib.crc32(b"the word before")
CAPITALS = zlib.crc32(b"in capitals")


def buckets(text: str, hashes: Hashes) -> np.ndarray:
    """Buckets of a text's words and bigrams. A word like the one before becomes a sign of its own, and each
    word in capitals adds one."""
    found = TOKEN.findall(text)
    if not found:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    again = h[1:] == h[:-1]
    h[1:][again] = SAME
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)
    loud = sum(t.isupper() and len(t) > 1 for t in found) if not text.islower() else 0
    extra = np.full(loud, CAPITALS % BUCKETS, dtype=np.int64)
    return np.concatenate([(h % np.uint64(BUCKETS)).astype(np.int64), pairs.astype(np.int64), extra])


def count_buckets(docs: DataFrame, text: str, target: str) -> DataFrame:
    """Counts per bucket in all texts and in those with ``target`` set; each task sends its sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, raw, good = Hashes(), np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for whole in batches:
            for part in slices(whole, 0):
                for value, chosen in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = np.bincount(buckets(value or "", hashes), minlength=BUCKETS)
                    raw += found
                    if chosen:
                        good += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    parts = docs.select(F.col(text), F.col(target)).mapInArrow(run, "bucket bigint, raw bigint, good bigint")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))


def labelled_sample(labels: DataFrame, doc_id: str, rows: int) -> DataFrame:
    """A bounded table of ``_id``, ``_good`` and ``_fit``; a document is good if all its labels say so and none says toxic, and bad otherwise."""
    each = labels.select(F.col(doc_id).alias("_id"), F.col("quality").alias("q"), F.col("toxic").alias("t")).filter("_id is not null and (q is not null or t = 1)")
    right = (F.coalesce(F.min("q"), F.lit(0)) == 1) & (F.coalesce(F.max("t"), F.lit(0)) == 0)
    judged = each.groupBy("_id").agg(right.alias("_good"))
    place = F.xxhash64("_id")
    kept = judged.orderBy(place, "_id").limit(rows).select("_id", "_good", (F.pmod(place, F.lit(4)) != 0).alias("_fit")).collect()
    return labels.sparkSession.createDataFrame(kept, f"_id {dict(judged.dtypes)['_id']}, _good boolean, _fit boolean")


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Log ratio of target and raw probability of each bucket; 0 throughout without a target.

    Raw counts are scaled to the size of the target sample before both are smoothed, so that a bucket too rare
    to be expected in the sample says nothing.
    """
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, n, m in counts.collect():  # one row per bucket at most
        raw[bucket], good[bucket] = n, m
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + SMOOTH) / (raw * (good.sum() / raw.sum()) + SMOOTH))


def score(docs: DataFrame, ratios: np.ndarray, text: str, carry: tuple[str, ...], temper: float = 0.0) -> DataFrame:
    """``importance``, the log of the ratio of both models, over the number of features to the power of ``temper``; and that number."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def judge(texts: list[str | None]) -> list[list]:
        hashes = Hashes()
        found = [buckets(t or "", hashes) for t in texts]
        return [[float(shared.value[b].sum()) / max(1, len(b)) ** temper for b in found], [len(b) for b in found]]

    return text_map(docs, judge, "importance double, n_features bigint", [text], carry)


def boundary(scores: list[tuple[float, bool]]) -> float:
    """The importance that best parts good from bad, in the middle of the gap, but 0 at most: what leans to neither
    side is no junk. Below all if good or bad ones are missing."""
    good, bad = (np.sort([s for s, g in scores if g is side]) for side in (True, False))
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.unique(np.concatenate([good, bad]))
    lost = np.searchsorted(good, cuts, "left") / len(good) + 1 - np.searchsorted(bad, cuts, "left") / len(bad)
    best = int(np.flatnonzero(lost == lost.min())[-1])
    return min(0.0, float((cuts[best] + cuts[best - 1]) / 2)) if best else -np.inf


def kth_largest(keys: DataFrame, key: str, k: int) -> int | None:
    """The ``k``-th largest of whole numbers by counts at three widths; None if there are fewer than ``k``."""
    low, held = None, keys.select(F.col(key).alias("_k"))
    for width in (24, 12, 0):
        wide = F.shiftright("_k", width)
        part = held if low is None else held.filter(F.shiftright("_k", width + 12) == low)
        for at, n in sorted(part.groupBy(wide.alias("w")).count().collect(), reverse=True):  # one row per step of this width
            if n >= k:
                low = at
                break
            k -= n
        else:
            return None
    return low


def gumbel(doc_id: str, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the id."""
    unit = (F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: tuple[str, ...] = ("doc_id",),
    k: int | None = None,
    seed: int = 1,
    labelled_rows: int = LABELLED_ROWS,
    temper: float = 0.0,
) -> DataFrame:
    """``importance``, the noisy ``sample_key`` and whether a document is among the ``k`` largest (``kept``).

    One row per row of ``docs`` with the ``carry`` columns. The noise makes the ``k`` largest a sample without replacement, drawn by the
    ratio of the models; a ``temper`` above 0 weighs long texts less, which samples by another law. The raw model counts all documents; the target model and, if
    ``k`` is not given, the number to keep come from at most ``labelled_rows`` labelled documents: as many are kept as lie
    above the importance that best parts the good from the bad ones. Equal keys (steps of one in 2**20) at
    the last place are all kept, so are repeated rows alike. A null or empty text has importance 0; without good labels all
    importances are 0, and without good or without bad ones all rows are kept unless ``k`` says otherwise. Null
    ids share their noise and match no label. Other columns are ignored.
    """
    sample = labelled_sample(labels, doc_id, labelled_rows)
    ids = docs.withColumn("_id", F.col(doc_id))
    marked = ids.join(F.broadcast(sample), "_id", "left").withColumn("_target", F.coalesce(F.col("_good") & F.col("_fit"), F.lit(False)))
    ratios = log_ratios(count_buckets(marked, text, "_target"))
    scored = score(ids, ratios, text, tuple(dict.fromkeys((*carry, "_id"))), temper)
    key = F.round((F.col("importance") + NOISE * gumbel("_id", seed)) * STEPS).cast("bigint")
    scored = keep(scored.withColumn("_key", key), "quality")
    if k is None:
        met = scored.join(F.broadcast(sample.filter("not _fit")), "_id").groupBy("_id", "_good").agg(F.max("importance").alias("importance"))
        held = met.select("importance", "_good").collect()  # within the sample's bound
        k = scored.filter(F.col("importance") >= boundary([(s, g) for s, g in held])).count()
    last = kth_largest(scored, "_key", k) if k > 0 else None
    chosen = F.col("_key") >= last if last is not None else F.lit(k > 0)
    columns = [c for c in carry if c not in ("importance", "n_features", "sample_key", "kept")]
    return scored.select(*columns, "importance", "n_features", (F.col("_key") / STEPS).alias("sample_key"), chosen.alias("kept"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
