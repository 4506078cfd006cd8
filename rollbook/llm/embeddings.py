"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one class first. In each table a class's code is the signs of its products with some random planes; classes
with one code meet and their cosines are computed in double precision. A pair counts only in the first table
where it meets, so links are counted without being listed. A bucket of many classes is cut into chunks, and
pairs of chunks are separate pieces of work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import keep, read
from rollbook.llm.components import Forest, connected_components
from rollbook.operators.joins import left_join

COSINE = 0.95
#: Chance to find a pair just at the least cosine; closer pairs are found more surely.
RECALL = 0.9995
#: Classes of a bucket that would hold them evenly; more vectors get longer codes and more tables.
BUCKET = 24
#: Classes of a bucket that are compared in one piece.
CHUNK = 2_000
#: Rows dealt to a task's group, about.
CELL_ROWS = 20_000
#: Large buckets that may be broadcast; more are joined.
BROADCAST_BUCKETS = 50_000
#: Rows compared with a whole chunk at a time.
STRIP = 256


def plan_tables(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a code and number of tables for ``n`` classes."""
    bits = max(2, min(40, round(math.log2(max(n, 1) / BUCKET + 1))))
    met = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def planes(dim: int, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def codes_of(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Codes of each vector in each table."""
    signs = (vectors @ planes(vectors.shape[1], bits, tables) >= 0).reshape(len(vectors), tables, bits)
    return signs.astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def packed(codes: np.ndarray, width: int) -> list[bytes]:
    """The codes of each vector one after another, in so many bytes each."""
    parts = np.ascontiguousarray(codes, dtype="<i8").view(np.uint8).reshape(*codes.shape, 8)[:, :, :width]
    return [row.tobytes() for row in parts]


def unpacked(codes: list[bytes], width: int) -> np.ndarray:
    """Packed codes as numbers, a row for each vector."""
    parts = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1, width)
    whole = np.zeros((*parts.shape[:2], 8), dtype=np.uint8)
    whole[:, :, :width] = parts
    return whole.view("<i8")[:, :, 0]


def coded(classes: DataFrame, vector: str, bits: int, tables: int, single: bool) -> DataFrame:
    """``id``, ``n``, ``dim``, the vector's bytes and its packed codes."""
    kind, width = np.float32 if single else np.float64, width_of(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            places = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                vectors = np.stack([flat[places[r] : places[r + 1]] for r in rows])
                codes = codes_of(vectors.astype(np.float64), bits, tables)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)),
                    pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(packed(codes, width), pa.binary()),
                ], names=["id", "n", "dim", "vector", "codes"])

    return classes.select("id", "n", vector).mapInArrow(run, "id bigint, n bigint, dim int, vector binary, codes binary")


def width_of(bits: int) -> int:
    """Bytes of a code."""
    return -(-bits // 8)


def compare(single: bool, cosine: float, width: int):
    """Links of a group of buckets: (id, null, weight of its partners) and (id, smaller id, null), the latter as trees."""
    kind = np.float32 if single else np.float64

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, weights, chunk = (rows[c].to_numpy() for c in ("id", "n", "chunk"))
        earlier_codes = rows["earlier"].to_numpy()
        rows["code"] = unpacked(rows["code"].tolist(), width)[:, 0]
        keys = rows[["dim", "t", "code", "i", "j"]].to_numpy()
        order = np.lexsort(keys.T)
        starts = np.flatnonzero(np.concatenate([[True], (keys[order][1:] != keys[order][:-1]).any(axis=1)]))
        linked = np.zeros(len(rows), dtype=np.int64)
        forest = Forest()
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            at = order[a:b]
            if len(at) < 2:
                continue
            _, t, _, i, j = keys[at[0]]
            codes = None
            vectors = np.stack([np.frombuffer(v, dtype=kind) for v in rows["vector"].to_numpy()[at]]).astype(np.float64)
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            left = np.arange(len(at)) if i == j else np.flatnonzero(chunk[at] == i)
            right = left if i == j else np.flatnonzero(chunk[at] == j)
            for s in range(0, len(left), STRIP):
                strip = left[s : s + STRIP]
                near = (vectors[strip] @ vectors[right].T) / (norms[strip][:, None] * norms[right][None, :]) >= cosine
                x, y = np.nonzero(near)
                x, y = strip[x], right[y]
                if i == j:
                    x, y = x[x < y], y[x < y]
                if t and len(x):
                    codes = unpacked(earlier_codes[at].tolist(), width) if codes is None else codes
                    new = np.ones(len(x), dtype=bool)
                    for earlier in range(t):
                        new &= codes[x, earlier] != codes[y, earlier]
                    x, y = x[new], y[new]
                np.add.at(linked, at[x], weights[at[y]])
                np.add.at(linked, at[y], weights[at[x]])
                for p, q in set(zip(ids[at[x]].tolist(), ids[at[y]].tolist(), strict=True)):
                    forest.join(p, q)
        nodes, roots = forest.links()
        found = np.flatnonzero(linked)
        return pd.concat([
            pd.DataFrame({"a": ids[found], "b": pd.array([None] * len(found), "Int64"), "w": linked[found]}),
            pd.DataFrame({"a": np.array(nodes, np.int64), "b": pd.array(roots, "Int64"), "w": np.zeros(len(nodes), np.int64)}),
        ])

    return run


def link_classes(classes: DataFrame, vector: str, single: bool, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Rows of ``compare`` for all classes (``id``, ``n``, vector)."""
    n = classes.count()
    bits, tables = plan_tables(n, cosine, recall)
    width = width_of(bits)
    base = keep(coded(classes, vector, bits, tables, single), "codes")
    rows = base.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    # a copy of a vector carries the codes of earlier tables only: they tell whether a pair met there
    rows = rows.withColumns({"code": F.substr("codes", F.col("t") * width + 1, F.lit(width)), "earlier": F.substr("codes", F.lit(1), F.col("t") * width)})
    rows = rows.drop("codes")
    sizes = rows.groupBy("dim", "t", "code").agg(F.count("*").alias("size")).filter(F.col("size") > CHUNK)
    large = keep(sizes.select("dim", "t", "code", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), "buckets")
    if large.count() <= BROADCAST_BUCKETS:
        rows = rows.join(F.broadcast(large), ["dim", "t", "code"], "left")
    else:
        rows = left_join(rows, large, ["dim", "t", "code"])
    chunks = F.coalesce("chunks", F.lit(1))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "vector"), chunks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    cells = max(1, math.ceil(n * tables / CELL_ROWS))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("dim", "t", "code", "i", "j"), F.lit(cells)).cast("int"))
    columns = ["cell", "dim", "t", "code", "i", "j", "chunk", "id", "n", "vector", "earlier"]
    return rows.select(*columns).groupBy("cell").applyInPandas(compare(single, cosine, width), "a bigint, b bigint, w bigint")


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Vectors link at a cosine of at least ``cosine``, computed in double precision. A vector links with nothing if it is null,
    empty or zero, holds a null or a component that is not finite, or has a null id; its component is its own id. Vectors of different
    lengths don't link. Equal vectors always do, repeated rows count as vectors of their own, and other columns are
    ignored. A pair just at the least cosine is found with a chance of ``recall``; nothing below is linked.
    """
    single = vectors.schema[vector].dataType.elementType == T.FloatType()
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sound = F.coalesce(F.col("id").isNotNull() & fine & (norm > 0) & (norm < float("inf")), F.lit(False))
    rows = rows.withColumn("vector", F.when(sound, F.col("vector")))
    grouped = rows.filter("vector is not null").groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = keep(grouped, "vectors")
    found = keep(link_classes(classes, "vector", single, cosine, recall), "vector-links")
    partners = found.filter("b is null").groupBy("a").agg(F.sum("w").alias("w")).withColumnRenamed("a", "id")
    components = connected_components(found.filter("b is not null")).withColumnRenamed("node", "id")
    named = left_join(left_join(classes, partners, ["id"]), components, ["id"])
    named = named.select("vector", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    joined = left_join(rows, named, ["vector"])
    return joined.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"), F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"),
    )


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a)
  SELECT a, min(b) AS least FROM r GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(r.least, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(r.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN reach r ON r.a = e.vec_id
"""
