"""Requests answered together, keywords in batches, deep pages by selection, counts kept up to date."""

import random
import re

import pytest
from conftest import tuples
from pyspark.sql import functions as F
from test_folds import feed, random_case, state

from rollbook.functions.ordering import order_pairs, ordered
from rollbook.operators import ranking
from rollbook.operators.access import Listing, scoped_rows
from rollbook.operators.counts import update_counts
from rollbook.operators.folds import upsert_scores
from rollbook.operators.keyword_search import search_keywords
from rollbook.operators.page_requests import page_requests
from rollbook.operators.paging import count_active, order_page
from rollbook.operators.selection import select_range

ROWS = [(f"k{i % 3 if i % 5 else 0}", i, i * 7 % 23 if i % 11 else None, int(i % 6 > 0)) for i in range(400)] + [(None, 900, 1, 1)]
ASK = "request_id bigint, k string, page int, size int, direction string"


def asked(r, n):
    return [(i, r.choice(["k0", "k0", "k1", "k2", "none", None]), r.choice([1, 1, 2, 5, 40, 0, None]), r.choice([1, 7, 64, 200, 0]), r.choice(["asc", "DESC", None, "up"])) for i in range(n)]


def answer(rows, request):
    _, k, page, size, way = request
    mine = sorted((v is not None, v or 0, i) for key, i, v, status in rows if status and (k is ... or (key == k and k is not None)))
    if (way or "").lower() == "desc":
        mine.sort(key=lambda r: (-r[0], -r[1], r[2]))
    return [(pos, r[2]) for pos, r in enumerate(mine, 1) if (page - 1) * size < pos <= page * size], len(mine)


@pytest.mark.parametrize("hot_rows", [ranking.HOT_ROWS, 40])
def test_each_request_gets_its_page(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(ranking, "LEAST_PIECE", 1)
    requests = asked(random.Random(1), 120)
    table = spark.createDataFrame(ROWS, "k string, i int, v int, status int")
    got = page_requests(spark.createDataFrame(requests, ASK), table, ["k"], ["i"], "v", "i", hot_rows)
    fine = [q for q in requests if q[2] and q[3] and q[4] != "up"]
    want = [(q[0], pos, i) for q in fine for pos, i in answer(ROWS, q)[0]]
    assert tuples(got.rows, "request_id", "pos", "i") == sorted(want, key=lambda r: [(True, str(v)) for v in r])
    totals = {r["request_id"]: (r["total"], r["total_page"]) for r in got.totals.collect()}
    assert totals == {q[0]: (n := answer(ROWS, q)[1], -(-n // q[3])) for q in fine}
    reasons = {r["request_id"]: r["reason"] for r in got.rejected.collect()}
    assert reasons == {q[0]: "direction" if q[4] == "up" else "page" if not q[2] else "size" for q in requests if q not in fine}


def test_requests_for_pages_of_the_whole_table(spark):
    requests = [(1, 1, 5, "asc"), (2, 3, 100, "desc"), (3, 50, 100, "asc")]
    table = spark.createDataFrame(ROWS, "k string, i int, v int, status int")
    got = page_requests(spark.createDataFrame(requests, "request_id bigint, page int, size int, direction string"), table, [], ["i", "k"], "v", "i")
    want = [(q, pos, i) for q, page, size, way in requests for pos, i in answer(ROWS, (q, ..., page, size, way))[0]]
    assert sorted(map(tuple, got.rows.select("request_id", "pos", "i").collect())) == sorted(want)


def test_scoped_rows(spark):
    courses = spark.createDataFrame([(i, f"C{i}", i % 2, 1) for i in range(9)], "course_uid int, course_name string, teacher_uid int, status int")
    scores = spark.createDataFrame([(i % 4, i, i, 1) for i in range(12)], "student_uid int, course_uid int, score int, status int")
    schema = "request_id int, identity string, user_uid int, resource string, page int, size int, direction string"
    requests = spark.createDataFrame([
        (1, "teacher", 0, "course", 1, 3, "desc"), (2, "student", 0, "course", 1, 3, "asc"), (3, "student", 3, "own_score", 2, 2, "asc"),
        (4, "teacher", 7, "course", 1, 3, "asc"), (5, "teacher", 1, "class", 1, 1, "asc"), (6, "teacher", 0, "course", 0, 3, "asc"), (7, None, 0, None, 1, 1, None),
    ], schema)
    got = scoped_rows(requests, {"course": Listing(courses, ["course_uid"], "course_uid", "course_uid"), "own_score": Listing(scores, ["course_uid"], "score", "course_uid")})
    assert sorted(map(tuple, got.pages["course"].rows.select("request_id", "pos", "course_uid").collect())) == [(1, 1, 8), (1, 2, 6), (1, 3, 4)]
    assert sorted(map(tuple, got.pages["own_score"].rows.select("request_id", "pos", "course_uid").collect())) == [(3, 3, 11)]
    assert tuples(got.refused, "request_id", "reason") == [(2, "forbidden"), (5, "forbidden"), (6, "page"), (7, "forbidden")]


def test_keywords_equal_like(spark):
    r = random.Random(2)
    bits = ["a", "b", "ab", "abc", "%", "_", "\\", " ", "é", "日本", ".", "*"]
    keywords = ["".join(r.choices(bits, k=r.randint(0, 4))) for _ in range(80)] + ["%", "__", "", None, "a%b", "abcabc"]
    texts = [("".join(r.choices([b for b in bits if b != "%"], k=r.randint(0, 7))) or None) for _ in range(200)]
    rows = [(i, texts[i], texts[-i]) for i in range(200)]
    table = spark.createDataFrame(rows, "uid int, one string, two string")
    got = search_keywords(spark.createDataFrame([(k,) for k in keywords + keywords], "keyword string"), table, "uid", ["one", "two"])
    want = set()
    for k in {(k or "").replace(" ", "") for k in keywords} - {""}:
        pattern = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in k), re.DOTALL)
        want |= {(k, i) for i, *both in rows if any(t is not None and pattern.search(t) for t in both)}
    assert {tuple(row) for row in got.collect()} == want and got.count() == len(want)
    assert search_keywords(spark.createDataFrame([], "keyword string"), table, "uid", ["one"]).count() == 0
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("ways", [("asc", "desc"), ("desc nulls first", "asc nulls last")])
def test_selected_ranges_equal_a_sort(spark, ways):
    r = random.Random(3)
    rows = [(r.choice([None, *range(5)]), r.choice([None, "a", "B", "é", ""]), r.choice([None, 0.5, -1.0, float("nan")]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "a int, b string, c double, i int").repartition(5)
    order = [("a", ways[0]), ("b", ways[1]), ("c", ways[0]), ("i", "asc")]
    whole = [row["i"] for row in ordered(df, order).collect()]
    for offset, count in ((0, 3), (350, 20), (690, 50), (900, 5), (123, 1)):
        got = select_range(df, order, offset, count, enough=10)
        assert [row["i"] for row in got.collect()] == whole[offset : offset + count]
    equal = select_range(df.select(F.lit(1).alias("x"), "i"), [("x", "asc")], 100, 7, enough=10)
    assert equal.count() == 7


def test_deep_pages_sort_only_a_slice(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5000).alias("v"))
    page = order_page(df, "v desc", 40, 50, "id", top_rows=100)
    assert [row["v"] for row in page.collect()] == list(range(5000 - 39 * 50 - 1, 5000 - 40 * 50 - 1, -1))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan and "TakeOrderedAndProject" in plan


def test_orders_as_text(spark):
    assert order_pairs("a DESC NULLS FIRST, if(b, 1, 2) nulls last, c nulls first, desc desc") == [
        ("a", "desc nulls first"), ("if(b, 1, 2)", "asc nulls last"), ("c", "asc"), ("desc", "desc"),
    ]
    df = spark.createDataFrame([(1,), (None,), (2,)], "a int")
    assert [r[0] for r in ordered(df, "a desc nulls first").collect()] == [None, 2, 1]
    assert [r[0] for r in ordered(df, [("a", "asc nulls last")]).collect()] == [1, 2, None]
    for bad in ("nulls first", "asc nulls last", "a, desc"):
        with pytest.raises(ValueError):
            order_pairs(bad)


def test_counts_after_three_deliveries(spark):
    rows, events = random_case("score", 6)
    now, changes = state(spark, "score", *rows), feed(spark, "score", *events)
    totals = count_active(now, ["student_uid"])
    keys = ["course_uid", "student_uid"]
    for low, high in ((0, 20), (20, 21), (21, 99)):
        fold = upsert_scores(now, changes.where((F.col("event_id") > low) & (F.col("event_id") <= high)))
        before = now.join(fold.changed.select(*keys), keys, "left_semi")
        totals = update_counts(totals, before, fold.changed, ["student_uid"])
        totals = spark.createDataFrame(totals.collect(), totals.schema)
        now = spark.createDataFrame(fold.table.collect(), fold.table.schema)
        assert tuples(totals) == tuples(count_active(now, ["student_uid"]))


def test_counts_follow_rows_to_another_key(spark):
    schema = "uid int, c string, status int"
    before, after = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, None, 1)], schema), spark.createDataFrame([(1, "b", 1), (2, "a", 1), (3, None, 0)], schema)
    counts = spark.createDataFrame([("a", 1), (None, 1), ("z", 5)], "c string, total bigint")
    assert tuples(update_counts(counts, before, after, ["c"])) == [("a", 1), ("b", 1), ("z", 5)]


def test_only_rows_of_keys_asked_for_are_made_and_once(spark, monkeypatch):
    from rollbook.operators import page_requests as module, tables

    written, plans = {}, {}

    def spied(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        written[name] = tables.kept(df, name)
        return written[name]

    monkeypatch.setattr(module, "kept", spied)
    source = spark.range(2000).select((F.col("id") % 100).alias("course"), F.col("id").alias("student"), (F.col("id") % 7).alias("value"))
    made = source.groupBy("course", "student").agg(F.max("value").alias("score"), F.lit(1).alias("status"))
    asked = spark.createDataFrame([(1, 5, 1, 3, "asc"), (2, 5, 2, 3, "desc"), (3, None, 1, 3, "asc")], "request_id int, course bigint, page int, size int, direction string")
    got = module.page_requests(asked, made, ["course"], ["student", "score"], "score", "student")
    assert tuples(got.totals) == [(1, 20, 7), (2, 20, 7), (3, 0, 0)]
    assert got.rows.count() == 6
    assert written["page-rows"].count() == 20
    plan = plans["page-rows"]
    assert 0 <= plan.index("Aggregate") < plan.index("LeftSemi")
