"""Documents packed into as few token sequences as can be: dominating sets first, best fit for the rest.

What fits beside what depends on lengths alone, and there are no more lengths than a sequence has tokens. So the instance is a
count per length, however many documents there are. Martello and Toth's reduction fixes the small sets that
no other set with the same longest document can beat, and takes them out; best fit goes over what is left. The plan is a short list of
patterns, each used so many times; a document finds its place in it by its number among those of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import keep, read, slices
from rollbook.operators.joins import left_join

SEQUENCE_TOKENS, END_ID = 1024, 2

#: Texts of about so many bytes are encoded together.
BATCH_BYTES = 500_000

#: Fixed value: where byte-level tokenizers of this kind part a text before they merge bytes.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Signs beyond these, on whose class libraries may differ, and words of so many signs.
ODD = re.compile(r"[^\t\n\r\x20-\x7E\u00A1-\u017F\u2018-\u201E\u2026\u20AC]|[^\s]{2000}")

#: Numbers of pieces before each part of a table are broadcast up to so many rows.
BROADCAST_ROWS = 500_000

#: A pattern: ``(length, how many of it)`` of one sequence in order, and in how many sequences it is used.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by a byte-level tokenizer's file.

    Texts of plain signs go through a faster library with the same merges; all others through the one the file was made for.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # the others are shown by signs from 256 on
        byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in special}
        self.plain = tiktoken.Encoding("plain", pat_str=PARTS, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [t for t in texts if ODD.search(t)]
        found = iter(self.tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else ())
        odd_ids = iter([np.array(e.ids, dtype="<u4") for e in found])
        return [next(odd_ids) if ODD.search(t) else self.plain.encode_to_numpy(t, allowed_special="all").astype("<u4") for t in texts]


def cut(
    docs: DataFrame, path: str, size: int = SEQUENCE_TOKENS, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of the token ids of each text and ``end_id``: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and perhaps ``ids``.

    Documents of up to ``size`` ids are one piece; longer ones are cut so that all but the first piece have ``size``. A null text is
    empty and has one id. Repeated rows are documents of their own, null ids stay null, an empty table gives no rows;
    other columns are not read. ``path`` names the tokenizer's file on every executor.
    """
    kind = docs.schema[doc_id].dataType
    fields = [T.StructField("doc_id", kind), *T.StructType.fromDDL("piece int, start bigint, length bigint, ids_crc32 bigint")]
    schema = T.StructType([*fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path)
        for whole in batches:
            for part in slices(whole, 1, BATCH_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows, columns, lists = [], [[], [], [], []], []
                for row, ids in enumerate(encoder.encode(texts)):
                    ids = np.append(ids, np.array([end_id], dtype="<u4"))
                    edges = [0, *range(len(ids) - (len(ids) - 1) // size * size, len(ids) + 1, size)]
                    for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                        rows.append(row)
                        for column, value in zip(columns, (piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                            column.append(value)
                        if with_ids:
                            lists.append(ids[a:b])
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [part.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
                arrays += [pa.array([i.astype("int32") for i in lists], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def least_of(counts: dict[int, int], sizes: list[int], n: int) -> list[int]:
    """The ``n`` smallest items, or all there are, of ascending ``sizes``."""
    out: list[int] = []
    for s in sizes:
        out += [s] * min(counts[s], n - len(out))
        if len(out) == n:
            break
    return out


def best_pair(counts: dict[int, int], sizes: list[int], room: int) -> int:
    """The largest sum of two items that fits, 0 if none does."""
    best, high = 0, len(sizes) - 1
    for low, s in enumerate(sizes):
        while high >= 0 and s + sizes[high] > room:
            high -= 1
        if high < low:
            break
        if high > low or counts[s] > 1:
            best = max(best, s + sizes[high])
        elif high == low and low:
            best = max(best, s + sizes[low - 1])
    return best


def dominating(item: int, counts: dict[int, int], room: int) -> tuple[int, ...] | None:
    """Items that fill ``room`` beside ``item`` at least as well as any others, whatever the rest needs; None if no such set is small.

    ``counts`` are the items left besides. A set dominates another if the other's items can be put in groups, each of which is no
    larger than one of its own items.
    """
    sizes = [s for s in sorted(counts) if s <= room and counts[s]]
    if not sizes:
        return ()
    largest = sizes[-1]
    least = least_of(counts, sizes, 3)
    if largest == room or sum(least[:2]) > room or len(least) < 2:
        return (largest,)
    if len(least) == 3 and sum(least) <= room:
        return None
    pair = best_pair(counts, sizes, room)  # two more at most
    if pair <= largest:
        return (largest,)
    partner = max((s for s in sizes if s <= room - largest and counts[s] > (s == largest)), default=0)
    if partner and largest + partner == pair:
        above = least_of(counts, [s for s in sizes if s > partner], 2)
        if len(above) < 2 or sum(above) > room:
            return (largest, partner)
    return None


def reduce_instance(counts: dict[int, int], size: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that belong to some best packing, and the counts left. Taking items away keeps a fixed set dominating, so it is used as often as its items last."""
    left, fixed, changed = Counter({s: n for s, n in counts.items() if n}), [], True
    while changed:
        changed = False
        for item in sorted(left, reverse=True):
            while left[item]:
                others = dict(left)
                others[item] -= 1
                found = dominating(item, others, size - item)
                if found is None:
                    break
                need = Counter((item, *found))
                times = min(left[s] // n for s, n in need.items())
                if not times:
                    break
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                left.subtract({s: n * times for s, n in need.items()})
                left += Counter()
                changed = True
    return fixed, dict(left)


def best_fit(counts: dict[int, int], size: int) -> list[Pattern]:
    """Best fit by descending length; equal items are placed together, just as one by one."""
    open_bins: dict[int, list[list]] = {}  # room left: [items, sequences]

    def put(items: tuple, n: int, room: int) -> None:
        if n:
            open_bins.setdefault(room, []).append([items, n])

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            room = min((r for r in open_bins if r >= s), default=None)
            if room is None:
                per = size // s
                put(((s, per),), left // per, size - per * s)
                if left % per:
                    put(((s, left % per),), 1, size - left % per * s)
                left = 0
                continue
            group = open_bins[room]
            items, n = group.pop()
            if not group:
                del open_bins[room]
            per = room // s
            full = min(n, left // per)
            put((*items, (s, per)), full, room - per * s)
            left -= full * per
            n -= full
            if n and left:
                put((*items, (s, left)), 1, room - left * s)
                left, n = 0, n - 1
            put(items, n, room)
    return [(items, n) for group in open_bins.values() for items, n in group]


def arrange(counts: dict[int, int], size: int) -> list[Pattern]:
    """The whole plan. Lengths are from 1 to ``size``."""
    if any(not 1 <= s <= size for s in counts):
        raise ValueError(f"lengths must be from 1 to {size}")
    fixed, left = reduce_instance(counts, size)
    return fixed + best_fit(left, size)


def places_of(plan: list[Pattern]) -> dict[str, np.ndarray]:
    """The plan by length: from which number on, in how many a sequence, first sequence and place within it."""
    taken, rows, sequence = Counter(), [], 0
    for items, times in plan:
        offset = 0
        for s, per in items:
            rows.append((s, taken[s], per, sequence, offset))
            taken[s] += per * times
            offset += per * s
        sequence += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "per", "sequence", "offset"), columns))


def numbered(pieces: DataFrame, length: str = "length") -> DataFrame:
    """Pieces with ``_number``, which counts those of each length from 0. Written once, so the numbers stay.

    Tasks number what they hold; the numbers before a task come from one count per task and length. So no length, however common, goes to one task.
    """
    schema = T.StructType([*pieces.schema, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    at = pieces.columns.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            sizes = batch.column(at).to_numpy(zero_copy_only=False)
            order = np.argsort(sizes, kind="stable")
            local = np.empty(len(sizes), dtype=np.int64)
            groups = np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(sizes) else []
            for group in groups:
                s = int(sizes[group[0]])
                local[group] = seen.get(s, 0) + np.arange(len(group))
                seen[s] = seen.get(s, 0) + len(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], names=schema.names)

    rows = keep(pieces.withColumn("_part", F.spark_partition_id()).mapInArrow(run, schema), "pieces")
    sums = keep(rows.groupBy("_part", length).agg(F.count("*").alias("_n")), "piece-counts")
    earlier = Window.partitionBy(length).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", length, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    small = sums.count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(before), ["_part", length]) if small else left_join(rows, before, ["_part", length])
    return met.select(*pieces.columns, (F.col("_before") + F.col("_local")).alias("_number"))


def pack(pieces: DataFrame, size: int = SEQUENCE_TOKENS, length: str = "length") -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, their place there; sequences have no gaps and at most ``size`` tokens.

    Lengths must be from 1 to ``size``. Equal pieces may change places. No rows give none. Columns of those names are replaced.
    """
    rows = numbered(pieces.drop("sequence_id", "offset"), length)
    # one row per length, so at most ``size``; a plan has at most three patterns for each, of few lengths
    counts = {r[0]: r[1] for r in rows.groupBy(length).agg(F.count("*")).collect()}
    shared = pieces.sparkSession.sparkContext.broadcast(places_of(arrange(counts, size)))
    carried = [f for f in rows.schema if f.name != "_number"]
    schema = T.StructType([*carried, *T.StructType.fromDDL("sequence_id bigint, offset bigint")])
    at = [f.name for f in carried].index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        starts = np.searchsorted(plan["length"], np.arange(size + 2))
        for batch in batches:
            sizes, numbers = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at, len(carried)))
            found = np.empty(len(sizes), dtype=np.int64)
            for s in np.unique(sizes):
                mine, a, b = sizes == s, starts[s], starts[s + 1]
                found[mine] = a + np.searchsorted(plan["first"][a:b], numbers[mine], "right") - 1
            nth = numbers - plan["first"][found]
            per = plan["per"][found]
            ids, offsets = plan["sequence"][found] + nth // per, plan["offset"][found] + nth % per * sizes
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=schema.names)

    return rows.select(*[f.name for f in carried], "_number").mapInArrow(run, schema)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(read(spark, sf_dir, "documents"), tokenizer_path()))
