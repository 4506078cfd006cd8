import datetime as dt
import random

import pytest
from conftest import tuples
from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.operators import ranking
from rollbook.operators.paging import (
    first_match,
    first_row,
    listing,
    order_page,
    page_counts,
    pages,
    paginate,
    query,
    query_counts,
)
from rollbook.operators.ranking import key_rank, pieces_of

SCHEMAS = {
    "date": ("date", lambda r: dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(3))),
    "timestamp": (
        "timestamp",
        lambda r: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(4), microseconds=r.randrange(3)),
    ),
    "double": ("double", lambda r: r.choice([-1.5, -0.5, 0.25, 7.0, 7.5, float("nan"), 1e300, -1e300])),
    "decimal": ("decimal(10,2)", lambda r: __import__("decimal").Decimal(r.randrange(-300, 300)) / 100),
    "bigint": ("bigint", lambda r: r.choice([-(2**60), -70000, 0, 5, 70000, 2**40, 2**62])),
    "string": ("string", lambda r: r.choice(["", "a", "ab", "abcd", "abce", "b"])),
}


CASES = [
    ("date", "desc", "uid"),
    ("timestamp", "asc", "num"),
    ("timestamp", "desc", "uid"),
    ("double", "asc", "uid"),
    ("decimal", "desc", "num"),
    ("bigint", "asc", "num"),
    ("string", "desc", "uid"),
]


@pytest.fixture(autouse=True)
def small_pieces(monkeypatch):
    """Pieces as small as asked for, so that few rows make many."""
    monkeypatch.setattr(ranking, "LEAST_PIECE", 1)


@pytest.mark.parametrize(("kind", "way", "tie"), CASES)
def test_chunked_rank_equals_row_number(spark, kind, way, tie):
    """Hot keys are numbered in chunks; the numbers are those of one window, NULLs included."""
    sql_type, make = SCHEMAS[kind]
    r = random.Random(7)
    rows = [
        (r.choice(["hot", "hot", "warm", f"k{i % 9}"]), make(r) if r.random() > 0.1 else None, f"{i:04x}", i * 9000)
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, f"k string, v {sql_type}, uid string, num bigint")
    order = F.col("v").desc() if way == "desc" else F.col("v").asc()
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(order, tie)))
    got = key_rank(df, ["k"], ("v", way), tie, hot_rows=20)
    assert tuples(got, "uid", "pos") == tuples(want, "uid", "pos")


def test_whole_table_rank_and_missing_keys(spark):
    rows = [(None if i % 3 == 0 else "a", i % 5, i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v int, uid int")
    got = key_rank(df, [], ("v", "desc"), "uid", hot_rows=5)
    assert [r.uid for r in got.orderBy("pos").collect()] == [
        i for _, _, i in sorted(rows, key=lambda t: (-t[1], t[2]))
    ]
    assert key_rank(df, ["k"], ("v", "asc"), "uid", hot_rows=5).count() == 40


@pytest.mark.parametrize("hot_rows", [4, 1000])
def test_first_rows_of_every_key(spark, hot_rows):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("v"), "id")
    got = key_rank(df, ["k"], ("v", "asc"), "id", hot_rows=hot_rows, first=5)
    whole = key_rank(df, ["k"], ("v", "asc"), "id").where("pos <= 5")
    assert tuples(got, "id", "pos") == tuples(whole, "id", "pos")


def test_pages_cover_each_key_once(spark):
    df = spark.range(101).select((F.col("id") % 4).alias("k"), (F.col("id") % 6).alias("v"), "id")
    paged = pages(df, ["k"], ("v", "desc"), "id", size=7)
    assert paged.select("id").distinct().count() == paged.count() == 101
    last = paged.groupBy("k").agg(F.max("page").alias("total_page"), F.count("id").alias("total"))
    assert tuples(last, "k", "total", "total_page") == tuples(page_counts(df, ["k"], 7))
    sizes = paged.groupBy("k", "page").count().where("count > 7")
    assert sizes.count() == 0
    third = pages(df, ["k"], ("v", "desc"), "id", size=7, page=3)
    assert tuples(third, "id") == tuples(paged.where("page = 3"), "id")


def test_page_limits(spark):
    df = spark.range(21).withColumn("k", F.lit(1))
    assert pages(df, ["k"], ("id", "asc"), "id", 20, page=3).count() == 0
    for page, size in ((0, 20), (1, 0)):
        with pytest.raises(ValueError):
            pages(df, ["k"], ("id", "asc"), "id", size, page=page)
    with pytest.raises(ValueError):
        order_page(df, "id", 0, 20)
    with pytest.raises(ValueError):
        order_page(df, "id desc, asc", 1, 20)
    assert order_page(df, [("id", "asc")], 10_000_000, 20).count() == 0
    assert order_page(df, "id", 10_000_000, 20).count() == 0
    assert paginate(0) == (0, 20) and paginate(1, 5) == (0, 5) and paginate(3, 5) == (10, 5)


@pytest.mark.parametrize("order", [[("a", "desc"), ("b", "asc")], "a desc, abs(b - 5)", "", []])
def test_deep_page_equals_sorted_page(spark, order):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"))
    top = [order_page(df, order, p, 13).collect() for p in (1, 6, 16)]
    deep = [order_page(df, order, p, 13, top_rows=1).collect() for p in (1, 6, 16)]
    assert top == deep and [len(p) for p in top] == [13, 13, 5]
    if not order:
        assert [r.id for r in top[1]] == list(range(65, 78))


@pytest.mark.parametrize("uid", ["concat('student-', lpad(id, 9, '0'))", "md5(cast(id as string))"])
def test_pieces_of_a_hot_key(spark, uid):
    """Pieces have about half the size asked for, whatever the uids look like."""
    df = spark.range(20_000).selectExpr("1 as k", "id % 51 as score", f"{uid} as uid")
    sort = [F.col("score").desc(), F.col("uid")]
    sizes = [r[1] for r in pieces_of(df, ["k"], sort, 20_000, 2_000).groupBy("_piece").count().collect()]
    assert 15 <= len(sizes) <= 20 and max(sizes) <= 2_500
    got = key_rank(df, ["k"], ("score", "desc"), "uid", hot_rows=2_000)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(*sort)))
    assert got.select("uid", "pos").exceptAll(want.selectExpr("uid", "cast(pos as bigint) pos")).count() == 0 and got.count() == 20_000


def test_rank_without_a_tie(spark):
    df = spark.range(500).selectExpr("id % 2 as k", "id % 3 as v", "id")
    got = key_rank(df, ["k"], ("v", "asc"), None, hot_rows=50).collect()
    for k in (0, 1):
        own = sorted((r.pos, r.v) for r in got if r.k == k)
        assert [p for p, _ in own] == list(range(1, 251)) and [v for _, v in own] == sorted(v for _, v in own)


@pytest.mark.parametrize("hot_rows", [9, 10_000])
def test_rank_by_several_columns(spark, hot_rows):
    df = spark.range(300).select(
        (F.col("id") % 2).alias("k"), (F.col("id") % 5).alias("a"), (F.col("id") % 3 / 2).alias("b"), "id"
    )
    got = key_rank(df, ["k"], [("a", "desc"), ("b", "asc")], "id", hot_rows=hot_rows)
    w = Window.partitionBy("k").orderBy(F.desc("a"), "b", "id")
    assert tuples(got) == tuples(df.withColumn("pos", F.row_number().over(w)))


def test_first_page_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = pages(df, ["k"], ("id", "desc"), "id", 20, page=1)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_listing_hides_deleted_rows(spark):
    df = spark.createDataFrame(
        [("a", "u1", "Ann", 1, 1), ("a", "u2", "Bob", 0, 2), ("a", "u3", "Anna", 1, 3)],
        "k string, uid string, name string, status int, created int",
    )
    got = listing(df, ["k"], ["uid", "name"], ("created", "desc"), "uid", 1, "A n", ["name"])
    assert tuples(got, "uid", "page") == [("u1", 2), ("u3", 1)]


def test_generic_query(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, odd int")
    assert query(df, {"odd": 1}).count() == 5
    assert [r.id for r in query(df, {"odd": 1}, ["id"], "id", page=2, per_page=2).collect()] == [5, 7]
    assert [r.id for r in query(df, {}, ["id"], [("id", "desc")], page=1).collect()] == [9]
    assert [r.id for r in first_match(df, {"odd": 0}, [("id", "desc")]).collect()] == [8]
    assert tuples(query_counts(df, {"odd": 1}, 2)) == [(5, 3)]
    assert tuples(query_counts(df, {"odd": 7}, 2)) == [(0, 0)]


def test_first_row_combines_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    got = first_row(df, ["k"], ["o"], ["o", "v"])
    assert tuples(got) == [("a", 1, "y"), ("b", 5, "z")]
    mixed = first_row(df, ["k"], [("o", "desc"), ("v", "asc")], ["o", "v"])
    assert tuples(mixed) == [("a", 2, "x"), ("b", 5, "z")]
    assert "partial_min_by" in got._jdf.queryExecution().toString()
