"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``d`` bits have a word halfway: within ``d / 2`` bits of both. So every distinct fingerprint
emits all words within half the distance, equal words meet in a shuffle, and those that share one are near.
Words are mixed by a bijection and dealt to cells by their leading bits; a word is shared by as many fingerprints as a ball
has words at most, so no cell is hot. The emitted words go through the shuffle as sorted arrays, in several
rounds over a part of all cells each, which bounds the disk that they take.
"""

from __future__ import annotations

import gc
import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import keep, read, text_map
from rollbook.llm.components import Forest, connected_components
from rollbook.operators.joins import left_join
from rollbook.session import shared_folder

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42

#: Rounds in which the emitted words are shuffled; ten bytes a word, so a distinct fingerprint takes 2.6 kB in each.
ROUNDS = 8
#: Words of a cell, on average.
CELL_WORDS = 2_000_000
#: Fingerprints whose words a task holds at a time.
CHUNK = 2_048

#: An odd factor and its inverse modulo 2**64 mix words and restore them.
MIX = 0x9E3779B97F4A7C15
UNMIX = pow(MIX, -1, 1 << 64)


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Bits set in over half the XXH64 hashes of the shingles, repeats included; 0 without a word."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # lowers A-Z, parts at space and \t to \r
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    last = min(words, len(found)) - 1
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[a : b - 1], SEED) for a, b in zip(starts, ends[last:], strict=False)], dtype=">u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        set_bits += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(bits: int) -> np.ndarray:
    """All words of 64 bits with at most ``bits`` set."""
    masks = [sum(1 << i for i in c) for n in range(bits + 1) for c in itertools.combinations(range(64), n)]
    return np.array(masks, dtype=np.uint64)


def near_links(fingerprints: DataFrame, max_bits: int = MAX_BITS, rounds: int = ROUNDS, cell_words: int = CELL_WORDS) -> DataFrame:
    """Links ``a``, ``b`` that connect distinct fingerprints (``fp``) just as all pairs within ``max_bits`` would.

    ``max_bits`` must be even: then all fingerprints that share a word are within it of each other, and links to the smallest
    of them stand for all pairs. Each is verified all the same; then those of a cell are thinned to trees, whose links need
    not be near themselves.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    spark = fingerprints.sparkSession
    masks = ball(max_bits // 2)
    n = fingerprints.count()
    cells = max(1, math.ceil(n * len(masks) / rounds / cell_words))
    folder = f"{shared_folder(spark)}/simhash-{uuid.uuid4().hex}"
    schema = "cell int, words binary, masks binary"
    shared = spark.sparkContext.broadcast(masks)
    # few fingerprints make much work: deal them out in chunks, by value, so that a repeated task gets the same
    spread = fingerprints.repartition(max(1, math.ceil(n / CHUNK)), "fp")
    spread = keep(spread, "fingerprints")
    for turn in range(rounds):
        emitted = spread.mapInArrow(_emit(shared, turn, rounds, cells), schema)
        met = emitted.groupBy("cell").applyInPandas(_meet(shared, max_bits), "a bigint, b bigint")
        met.write.parquet(f"{folder}/{turn}")
        # Spark drops a shuffle's files once the driver has dropped its plan; do so before the next round fills the disk again
        del emitted, met
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema("a bigint, b bigint").parquet(*[f"{folder}/{turn}" for turn in range(rounds)])


def _emit(shared, turn: int, rounds: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = shared.value
        edges = [min((i << 64) // (rounds * cells), (1 << 64) - 1) for i in range(turn * cells, (turn + 1) * cells + 1)]
        low, high, inner = np.uint64(edges[0]), np.uint64(edges[-1]), np.array(edges[1:-1], dtype=np.uint64)
        last = turn == rounds - 1
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), CHUNK):
                mixed = (fps[at : at + CHUNK, None] ^ masks[None, :]) * np.uint64(MIX)
                chosen = mixed >= low if last else (mixed >= low) & (mixed < high)
                which = np.nonzero(chosen)[1].astype(np.uint16)
                words = mixed[chosen]
                order = np.argsort(words)
                words, which = words[order], which[order]
                cuts = [0, *np.searchsorted(words, inner).tolist(), len(words)]
                rows = [(c, a, b) for c, (a, b) in enumerate(itertools.pairwise(cuts)) if a < b]
                yield pa.RecordBatch.from_arrays([
                    pa.array([turn * cells + c for c, _, _ in rows], pa.int32()),
                    pa.array([words[a:b].tobytes() for _, a, b in rows], pa.binary()),
                    pa.array([which[a:b].tobytes() for _, a, b in rows], pa.binary()),
                ], names=["cell", "words", "masks"])

    return run


def _meet(shared, max_bits: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        words = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in rows["words"]])
        which = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in rows["masks"]])
        order = np.argsort(words)
        words, which = words[order], which[order]
        same = words[1:] == words[:-1]
        met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        words, which = words[met], which[met]
        if not len(words):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        owners = (words * np.uint64(UNMIX)) ^ shared.value[which]
        heads = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        least = np.repeat(np.minimum.reduceat(owners, heads), np.diff([*heads, len(words)]))
        near = (np.bitwise_count(owners ^ least) <= max_bits) & (owners != least)
        pairs = np.unique(np.stack([owners[near], least[near]], axis=1).view(np.int64), axis=0)
        forest = Forest()
        for a, b in pairs.tolist():
            forest.join(a, b)
        a, b = forest.links()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ("doc_id",), words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """``fp`` (the fingerprint as a signed number), ``component_id`` and whether a row is the first of its component (``kept``).

    One row per row of ``docs`` with the ``carry`` columns. A component holds all documents that links of at most
    ``max_bits`` differing bits reach; its id is the smallest document id in it, null if all are null. One row of each component
    is kept, the one with that id; repeated rows of that id are all kept. Rows without an id count as one document
    that comes after all others. A null or empty text has fingerprint 0, linked like
    any other. Other columns are ignored.
    """
    found = text_map(docs, lambda texts: [[signed(fingerprint(t or "", words)) for t in texts]], "fp bigint", [text], tuple(dict.fromkeys((*carry, doc_id))))
    found = keep(found, "simhash")
    ids = found.select("fp", F.col(doc_id).alias("_doc")).groupBy("fp").agg(F.min("_doc").alias("_first"))
    classes = keep(ids, "classes")
    components = connected_components(near_links(classes.select("fp"), max_bits))
    named = left_join(classes, components.withColumnRenamed("node", "fp"), ["fp"]).withColumn("_root", F.coalesce("component", "fp"))
    named = keep(named.select("fp", "_first", "_root"), "named")
    roots = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    of = left_join(named, roots, ["_root"]).select("fp", "component_id")
    columns = [c for c in carry if c not in ("fp", "component_id", "kept")]
    held = found.withColumn("_doc", F.col(doc_id)).select(*columns, "_doc", "fp")
    return left_join(held, of, ["fp"]).select(*columns, "fp", "component_id", F.col("_doc").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept")
