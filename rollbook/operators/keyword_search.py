"""Many keywords against many rows at once, as ``LIKE %keyword%`` would find them, without comparing all with all.

A row can only hold a keyword if it holds every gram of up to ``GRAM`` signs of the keyword's literal parts. Each keyword is looked up by the one
of these grams that fewest rows have; rows that share it are then compared with the whole pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.operators.joins import left_join
from rollbook.operators.tables import kept

GRAM = 3


def grams(text: Column, size: Column) -> Column:
    """All runs of ``size`` signs of a text; the empty one if the size is 0."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    found = F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))
    return F.when(size == 0, F.array(F.lit(""))).otherwise(found)


def like_pattern(keyword: Column) -> Column:
    """``%`` and ``_`` stay wildcards, a backslash is an ordinary sign."""
    return F.concat(F.lit("%"), F.replace(keyword, F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def search_keywords(keywords: DataFrame, rows: DataFrame, key: str, columns: Sequence[str], keyword: str = "keyword") -> DataFrame:
    """Pairs of ``keyword`` and ``key``, each once: the rows that hold the keyword in any of the columns.

    Keywords are taken without their spaces, as listings do; empty and NULL ones ask for nothing and are left out, repeated ones count once. A NULL text holds no
    keyword. A keyword of wildcards alone is compared with every row that has a text, as it may match them all.
    """
    asked = keywords.select(F.replace(F.col(keyword), F.lit(" "), F.lit("")).alias("keyword")).where("keyword <> ''").distinct()
    literal = F.array_max(F.transform(F.split("keyword", "[%_]"), lambda part: F.struct(F.length(part).alias("n"), part.alias("part"))))["part"]
    asked = asked.withColumn("_part", literal).withColumn("_size", F.least(F.length("_part"), F.lit(GRAM)))
    wanted = kept(asked.select("keyword", F.explode(grams(F.col("_part"), F.col("_size"))).alias("_gram")), "keyword-grams")
    sizes = [r[0] for r in wanted.select(F.length("_gram")).distinct().collect()]  # 0 to GRAM

    texts = F.array_distinct(F.array_compact(F.array(*[F.col(c).cast("string") for c in columns])))
    held = rows.select(F.col(key).alias("key"), F.explode(texts).alias("_text"))
    cut = F.array_distinct(F.flatten(F.array(*[grams(F.col("_text"), F.lit(n)) for n in sizes]))) if sizes else F.array().cast("array<string>")
    postings = left_join(held.withColumn("_gram", F.explode(cut)), wanted.select("_gram").distinct(), ["_gram"], "left_semi")
    postings = kept(postings.select("key", "_text", "_gram"), "postings")
    counts = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # a gram that no row has rules its keyword out
    rarest = left_join(wanted, counts, ["_gram"]).groupBy("keyword").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_rare"))
    chosen = rarest.where("_rare.n > 0").select("keyword", F.col("_rare.gram").alias("_gram"))
    met = left_join(postings, chosen, ["_gram"], "inner").withColumn("_pattern", like_pattern(F.col("keyword")))
    return met.where(F.expr("_text LIKE _pattern")).select("keyword", "key").distinct().withColumnRenamed("key", key)
