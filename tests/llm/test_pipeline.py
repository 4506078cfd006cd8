import random

import corpus_pipeline as C
from tests.llm.edges import documents


def test_stages(spark, tmp_path):
    """Planted junk, copies, test items and secrets go; clean documents stay as they are."""
    rng = random.Random(4)
    words = [rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(900)]
    clean = [(i, " ".join(rng.choice(words) for _ in range(120))) for i in range(120)]
    junk = [(200 + i, " ".join(rng.choice(words).upper() + "!!" for _ in range(120))) for i in range(30)]
    copies = [(300, clean[3][1]), (301, clean[3][1].upper())]
    item = " ".join(words[:16])
    tested = [(400, item + " " + clean[5][1][:200]), (401, " ".join(rng.choice(words) for _ in range(800)) + " " + item)]
    secret = [(500, clean[7][1][::-1] + " mail a.b@c.org")]
    rows = [*clean, *junk, *copies, *tested, *secret, (600, None), (601, "")]
    documents(spark, rows).select(*C.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in [*clean, *junk]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in C.STAGES:
        docs = C.keep(stage(spark, docs, str(tmp_path)), name)
        out[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != C.STAGES[-1][0]:
            assert docs.columns == list(C.COLUMNS)
    assert {i for i, _ in clean} <= set(out["quality"]) and not {i for i, _ in junk} & set(out["quality"])
    assert not {300, 301} & set(out["simhash"]) and {i for i, _ in clean} <= set(out["simhash"])
    assert 400 not in out["decontamination"] and item not in out["decontamination"][401]["text"]
    assert out["pii"][500]["text"].endswith("mail <EMAIL>")
    assert all(out["pii"][i]["text"] == t for i, t in clean)
    assert set(out["sentencepiece"]) == set(out["pii"]) and out["sentencepiece"][0]["n_tokens"] > 100
    assert all(r["round_trip"] for r in out["sentencepiece"].values())
    assert C.run(spark, str(tmp_path)).count() == len(out["sentencepiece"])


def test_stages_with_odd_rows(spark, tmp_path):
    """Rows without an id, repeated rows, null and empty texts, extra columns that clash, and empty tables."""
    rng = random.Random(5)
    words = [rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(600)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(8)]
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[1]), (2, texts[2]), (2, texts[3]), (9, texts[4]), (None, texts[4]), (3, None), (None, ""), (4, "")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert C.good_text(spark, docs, str(tmp_path)).count() == len(rows)
    left = [(r["doc_id"], r["text"] or "") for r in C.near_copies(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([(1, texts[0]), (None, texts[1]), (2, texts[2]), (2, texts[3]), (9, texts[4]), (3, "")], key=str)
    out = C.run(spark, str(tmp_path))
    assert out.count() == 6 and out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"]
    empty = str(tmp_path / "none")
    documents(spark, []).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{empty}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert C.run(spark, empty).count() == 0
