"""What the operators of this package share: words, texts mapped in Arrow batches, tables kept in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rollbook.operators.tables import kept

#: Letters and digits of ASCII, in lower case, and all that lies beyond ASCII make words; the rest parts them.
_LOWER = bytes(range(256)).lower()
WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in _LOWER)
#: The same words in a text whose case is kept, for their places.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Texts of this many characters are handed to a batch function together, at least one.
SLICE_CHARS = 4_000_000


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it: cut lineage, and nothing runs twice."""
    return kept(df, name)


class Shared:
    """A broadcast object. Its class travels with it, so executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value: Any):
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> Any:
        if not hasattr(self, "_value"):
            self._value = cloudpickle.loads(self._packed.value)
        return self._value

    def __getstate__(self) -> dict:
        return {"_packed": self._packed}

    def destroy(self) -> None:
        """Free it everywhere, the driver included. Call it once all that reads it is written."""
        self._packed.destroy()


def columns_of(df: DataFrame, names: Sequence[str], outputs: T.StructType) -> list[T.StructField]:
    """The fields of ``df`` to carry along; one that is named like an output gives way to it."""
    taken = {f.name for f in outputs}
    return [df.schema[c] for c in names if c not in taken]


def text_map(
    docs: DataFrame,
    batch: Callable[..., Sequence[list]],
    outputs: str,
    inputs: Sequence[str] = ("text",),
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Map rows in Arrow batches, one row out per row in: ``carry`` columns, then ``outputs``.

    ``batch`` gets one list per input column, the text first, and returns one list per output column. Other
    columns of ``docs`` are not read, so they cannot clash; a carried column that has an output's name is
    replaced, as by ``withColumn``.
    """
    made = T.StructType.fromDDL(outputs)
    fields = columns_of(docs, carry, made)
    n = len(fields)
    schema = T.StructType([*fields, *made])
    kinds = [to_arrow_type(f.dataType) for f in made]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, n):
                made_columns = batch(*[part.column(i).to_pylist() for i in range(n, part.num_columns)])
                arrays = [part.column(i) for i in range(n)]
                arrays += [pa.array(c, k) for c, k in zip(made_columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    given = [docs[c].alias(f"_in{i}") for i, c in enumerate(inputs)]
    return docs.select(*[docs[f.name] for f in fields], *given).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, so that very long texts don't pile up."""
    start = size = 0
    sizes = batch_sizes(batch.column(column))
    for i in range(batch.num_rows):
        size += sizes[i]
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def batch_sizes(column: pa.Array) -> list[int]:
    """Bytes of each text, or numbers of each list."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return pc.fill_null(pc.list_value_length(column), 0).to_pylist()
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()
