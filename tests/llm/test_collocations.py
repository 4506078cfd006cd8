import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from rollbook.llm import collocations as co

from .edges import documents


def brute(rows, least):
    """By counting every phrase in a dictionary."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + n])) for n in range(1, 6) for i in range(len(words) - n + 1))
    frequent = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    inside = set()
    for (lang, p), a in frequent.items():
        for n in range(2, len(p)):
            inside |= {(lang, p[i : i + n]) for i in range(len(p) - n + 1) if 100 * a >= 100 * counts[lang, p[i : i + n]]}
    out = []
    for (lang, p), a in frequent.items():
        if (lang, p) not in inside:
            n = totals[lang]
            score, _, l, r = min((1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, l, r, n, score))
    return sorted(out)


HARD = [
    (None, "en"), ("", None), ("a b\x01 c a b c", "en"), ("A\x01 b. a b\x0bc  a\tb c !a b", None), ("É é x\x1fy É é", "en"), ("x" * 30_000 + " a b " * 9, "en"),
    ("a b " * 200, "x y"), ("\n.\n a", "en"), ("end", "en"), ("a a a a a a a", "en"), ("　 b 　 b", "en"),
]


def rows(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(12)] + ["the"] * 8 + ["a", "ab", "a\x02", "Zé"]
    made = [(random.choice([" ", "  ", "\t"]).join(random.choice([random.choice(words), "one two three four five six"]) + random.choice(["", "", "", ".", "\n"]) for _ in range(40)), random.choice(["en", "de", None])) for _ in range(60)]
    return made + HARD + HARD


def table(spark, made):
    return documents(spark, [(i, t, lang) for i, (t, lang) in enumerate(made)])


def test_equals_counting(spark):
    made = rows(5)
    df = table(spark, made).repartition(7)
    for least, prune in ((2, 10**6), (5, 10**6), (5, 0)):  # 0: words are not broadcast, windows not cut
        got = sorted(map(tuple, co.collocations(df, least=least, prune_words=prune).collect()))
        assert got == brute(made, least)
    assert co.collocations(df.limit(0)).collect() == []
    assert co.collocations(df).columns == ["lang", "phrase", "a", "l", "r", "n", "score"]


def test_borders_of_ranges_and_batches(spark, monkeypatch):
    """Runs that go on over batches and ranges, and phrases opened in an earlier range."""
    made = rows(6)
    df = table(spark, made)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(co, "BATCH_ROWS", 5)
        assert sorted(map(tuple, co.collocations(df, least=3).collect())) == brute(made, 3)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert spark.conf.get("spark.sql.shuffle.partitions") == old


def test_runs_of_sorted_windows():
    windows = sorted(["a b ", "a b c ", "a b c ", "a b\x01 ", "a c ", "b a "])
    weights = pa.array([1] * 6).to_numpy()
    found = {(" ".join(windows[i].split(" ")[:k]), n) for k, i, n in co.runs_of(pa.array(windows), weights, 2)}
    assert found == {("a b\x01", 1), ("a b", 3), ("b a", 1), ("a b c", 2)}  # the first and the last row lie at borders


def test_exact_beyond_64_bits(spark):
    big = 4_000_000_000_000
    df = spark.createDataFrame([(big, 9 * big, big + 1, big + 3)], "a bigint, n bigint, l bigint, r bigint")
    exact = lambda c: c.cast("decimal(19,0)")
    product = df.select((exact(F.col("a") * co.SCALE) * exact(F.col("n"))).alias("_above"), (exact(F.col("l")) * exact(F.col("r"))).alias("_below"))
    assert product.selectExpr("_above div _below").first()[0] == 1000 * big * 9 * big // ((big + 1) * (big + 3))


def test_query_equals_sql(spark, tmp_path):
    made = rows(7) * 4
    table(spark, made).select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, co.op13_collocations(spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(duck.sql(co.ORACLE).fetchall()) and got
