import random

from rollbook.llm import urls

PAGES = "page_id bigint, url string, host string, verdict string, _key string, listed string, _block string"


def judged(spark, rows, listed, **more):
    pages = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], PAGES)
    out = urls.filter_urls(pages, spark.createDataFrame([(u, "x") for u in listed], "url string, _key string"), **more)
    return sorted(out.collect(), key=str)


def test_rules_and_list(spark):
    rows = [
        (0, None), (1, ""), (2, "no scheme.com/"), (3, "http://A.Example.com/en/x?q"), (4, "https://www.example.com/en/1"), (5, "x://net/es/"), (6, "x://planet/es/"), (7, "x://a.org/p/?utm_source=z"),
        (8, "y://www.a.org/p#f"), (9, "x://a.org/p?id=1&ref=2"), (9, "x://a.org/p?id=1&ref=2"), (10, "x://com"), (11, "x://b.com/?a"), (12, "x://é.org/" + "p" * 50_000),
    ]
    got = {r["page_id"]: r for r in judged(spark, rows, ["http://a.org/p", "q://a.org/p?id=1", "x://b.com/?a", None, "http://a.org/p"])}
    assert [got[i]["rule"] for i in range(12)] == [None, None, None, "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, None, "com/"]
    assert [got[i]["verdict"] for i in range(13)] == ["allow"] * 3 + ["block", "allow", "block", "allow", "block", "block", "block", "allow", "allow", "allow"]
    assert (got[3]["host"], got[3]["path"], got[0]["host"], got[2]["path"]) == ("a.example.com", "/en/x", "", "")
    assert len(judged(spark, rows, [])) == len(rows) and not any(r["listed"] for r in judged(spark, rows, []))
    assert judged(spark, [], ["x://a.org/"]) == []


def test_filter_lets_every_listed_url_pass(spark, monkeypatch):
    rng = random.Random(6)
    names = [f"x://h{rng.randint(0, 400)}.org/{rng.randint(0, 9)}" for _ in range(3000)]
    rows, listed = list(enumerate(names)), names[::7]
    broadcast = judged(spark, rows, listed)
    assert {r["page_id"] for r in broadcast if r["listed"]} == {i for i, n in rows if n in set(listed)}
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", 0)
    assert judged(spark, rows, listed) == broadcast


def test_filter_has_few_false_positives(spark):
    listed = spark.range(4000).selectExpr("concat('k', id) as _key")
    n_blocks = 1 << 7
    blocks = urls.bloom(listed, "_key", n_blocks)
    from pyspark.sql import functions as F

    others = spark.range(20_000).selectExpr("concat('o', id) as _key").withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(n_blocks)))
    met = others.join(blocks, "_block")
    for i, b in enumerate(urls.bits(F.col("_key"))):
        met = met.filter(F.col(f"_w{i}").bitwiseAND(urls.one_at(b)) != 0)
    assert met.count() < 200
