"""A training corpus made from ``documents`` in five stages; each is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import pieces, quality, simhash
from rollbook.llm.common import keep, read
from rollbook.llm.decontamination import decontaminate
from rollbook.llm.pii import detect
from rollbook.operators import tables
from rollbook.operators.joins import left_join

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling leaves out go.

    Labels are looked up by ``doc_id``; rows without an id are judged by their text like all others. Empty and null texts have importance 0. Equal
    keys at the border all stay. Without labels all rows stay.
    """
    return quality.resample(docs, read(spark, sf_dir, "labels"), carry=COLUMNS).filter("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, one of the smallest id.

    Rows are told apart by their place in the written files, so repeated rows and rows without an id count one by one; the
    latter come after all others. Null and empty texts are alike, and one of them stays. No rows give none.
    """
    place = F.concat_ws(":", F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~")), F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    marked = docs.select(*COLUMNS, place.alias("_row"))
    found = simhash.near_duplicates(marked, doc_id="_row", carry=("_row",))
    gone = found.filter("not kept").select("_row")
    return left_join(marked, gone, ["_row"], "left_anti").select(*COLUMNS)


def clean_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others, the few spans of test items are cut out. A null text has no words and stays, as all rows do without items."""
    judged = decontaminate(docs, read(spark, sf_dir, "benchmark"), carry=COLUMNS)
    left = judged.filter(~F.col("contaminated"))
    return with_text(left, F.when(F.col("n_hit") > 0, F.col("clean_text")).otherwise(F.col("text")))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kinds; a null text stays null, and repeated rows are masked alike."""
    return with_text(detect(docs, carry=COLUMNS), F.col("masked"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text back (``round_trip``). A null text has null ids."""
    return pieces.encode(docs, pieces.load(), carry=("doc_id", "lang", "source"))


def with_text(docs: DataFrame, text) -> DataFrame:
    """The columns of documents, with another text and its length."""
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


STAGES = [
    ("quality", good_text),
    ("simhash", near_copies),
    ("decontamination", clean_tests),
    ("pii", mask_personal),
    ("sentencepiece", encoded),
]

#: SQL has no way to fit the models, nor to match by automata and random fields.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage and the one before it wrote is removed once its own result is written; the last result reads the one left."""
    docs = read(spark, sf_dir, "documents")
    begun = tables.mark()
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        tables.remove(spark, begun, tables.mark() - 1)
        begun = tables.mark() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
