import random

import numpy as np
import pytest

from rollbook.llm import quality as Q
from tests.llm.edges import documents

LABELS = "doc_id bigint, quality int, toxic int, kept string"


def texts(rng, n, junk):
    return " ".join((rng.choice(["the", "of", "house", "tree", "sea"]) if not junk else rng.choice(["WIN!!", "cash ###", "ab", "ab"])) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows = [(i, texts(rng, rng.randint(1, 80), i % 5 == 0)) for i in range(400)] + [(900, None), (901, ""), (902, "the sea " * 40_000), (3, "the tree of the sea"), (None, "the house")]
    labels = [(i, 0 if i % 5 == 0 else 1, 1 if i % 50 == 1 else None, "x") for i in range(300)] + [(None, 1, 0, "x"), (4, None, None, "x")]
    return rows, documents(spark, rows), spark.createDataFrame(labels, LABELS)


def test_counts_and_scores_equal_brute_force(spark, corpus):
    rows, docs, labels = corpus
    out = Q.resample(docs, labels).collect()
    fit = {r["_id"] for r in Q.labelled_sample(labels, "doc_id", Q.LABELLED_ROWS).collect() if r["_good"] and r["_fit"]}
    raw, good = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    for i, t in rows:
        found = np.bincount(Q.buckets(t or "", Q.Hashes()), minlength=Q.BUCKETS)
        raw += found
        good += found if i in fit else 0
    ratios = np.log((good + 1) / (raw * good.sum() / raw.sum() + 1))
    want = sorted(round(ratios[b].sum(), 6) for b in (Q.buckets(t or "", Q.Hashes()) for _, t in rows))
    assert np.allclose(sorted(r["importance"] for r in out), want, atol=1e-5)


def test_good_stays_and_junk_goes(spark, corpus):
    rows, docs, labels = corpus
    out = Q.resample(docs, labels).collect()
    assert len(out) == len(rows)
    kept = {r["doc_id"] for r in out if r["kept"]}
    long = {i for i, t in rows if i is not None and i < 400 and len(t) > 60}
    assert {i for i in long if i % 5} <= kept and not {i for i in long if i % 5 == 0} & kept
    assert {900, 901} <= kept  # 902 says one thing 40,000 times


def test_top_k_is_exact(spark, corpus):
    rows, docs, labels = corpus
    for k in (0, 1, 57, 404, 405, 10_000):
        out = Q.resample(docs, labels, k=k).collect()
        keys = sorted((r["sample_key"] for r in out), reverse=True)
        assert sorted((r["sample_key"] for r in out if r["kept"]), reverse=True) == keys[:k]
        assert sum(r["kept"] for r in out) == min(k, len(rows))


def test_selection_by_counts(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.randint(-(1 << 45), 1 << 45), rng.randint(-9, 9)]) for _ in range(500)]
    keys = spark.createDataFrame([(v,) for v in values], "k bigint")
    for k in (1, 2, 250, 499, 500):
        assert Q.kth_largest(keys, "k", k) == sorted(values, reverse=True)[k - 1]
    assert Q.kth_largest(keys, "k", 501) is None


def test_noise_is_gumbel(spark):
    values = [r[0] for r in spark.range(20_000).select(Q.gumbel("id", 1)).collect()]
    assert abs(np.mean(values) - 0.5772) < 0.03 and abs(np.var(values) - np.pi**2 / 6) < 0.08


def test_without_labels_and_without_documents(spark, corpus):
    _, docs, labels = corpus
    none = spark.createDataFrame([], LABELS)
    out = Q.resample(docs, none).collect()
    assert all(r["kept"] and r["importance"] == 0 for r in out)
    assert Q.resample(documents(spark, []), labels).count() == 0
    assert Q.resample(documents(spark, []), none).count() == 0


def test_toxic_prose_is_bad_whatever_its_quality(spark):
    rng = random.Random(3)
    prose = "the river ran past an old mill and a field of wheat where children played until evening came".split()
    abuse = "idiot scum vermin filth moron".split()
    rows, marks = [], []
    for i in range(600):
        words = [rng.choice(prose) for _ in range(40)]
        if i % 4 == 0:
            words[::4] = [rng.choice(abuse) for _ in words[::4]]
        rows.append((i, " ".join(words)))
        if i < 400:
            marks.append((i, 1, int(i % 4 == 0)))
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    sample = {r["_id"]: r["_good"] for r in Q.labelled_sample(labels, "doc_id", 1000).collect()}
    assert sample == {i: t == 0 for i, _, t in marks}
    kept = {r["doc_id"] for r in Q.resample(documents(spark, rows), labels).collect() if r["kept"]}
    assert not {i for i in range(400, 600) if i % 4 == 0} & kept
    assert len({i for i in range(400, 600) if i % 4} & kept) > 145


def test_sample_is_drawn_by_the_ratio(spark):
    """Noise on log weights draws without replacement: the share of draws with each item equals that of drawing one by one by weight."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    weights, n = [8.0, 4.0, 2.0, 1.0, 0.5], 30_000
    total = sum(weights)
    want = [w / total + sum(v / total * w / (total - v) for j, v in enumerate(weights) if j != i) for i, w in enumerate(weights)]
    ids = spark.range(n * 5)
    key = F.log(F.get(F.array(*map(F.lit, weights)), (F.col("id") % 5).cast("int"))) + Q.gumbel("id", 1)
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy(F.floor(F.col("id") / 5)).orderBy(key.desc())))
    got = {r["i"]: r["count"] / n for r in ranked.filter("r <= 2").groupBy((F.col("id") % 5).alias("i")).count().collect()}
    assert all(abs(got[i] - w) < 0.012 for i, w in enumerate(want))


def test_importance_is_the_log_ratio(spark, corpus):
    rows, docs, labels = corpus
    plain = {r["doc_id"]: r for r in Q.resample(docs, labels).collect()}
    even = {r["doc_id"]: r for r in Q.resample(docs, labels, temper=0.5).collect()}
    for i, r in plain.items():
        assert abs(r["importance"] - even[i]["importance"] * max(1, r["n_features"]) ** 0.5) < 1e-6 * max(1, abs(r["importance"]))
