import pytest
from conftest import tuples
from pyspark.sql import functions as F

from rollbook.functions.ordering import direction, ordered
from rollbook.functions.predicates import (
    contains,
    items_from_kwargs,
    keyword_filter,
    normalize_keyword,
    where,
    where_kwargs,
)


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame(
        [(1, 1, "x"), (None, 2, "y"), (3, 3, None)], "a int, b int, c string"
    )


def test_comparisons(numbers):
    found = lambda items: [r[0] for r in tuples(numbers.where(where(items)), "b")]
    assert found([("a", 1, "=", "and")]) == [1]
    assert found([("a", 1, "!=", "and")]) == [3]
    assert found([("b", 2, "<=", "and")]) == [1, 2]
    assert found([("b", 2, ">", "and")]) == [3]
    assert found([("b", [1, 2], "between", "and")]) == [1, 2]
    assert found([("c", ["x", "y"], "in", "and")]) == [1, 2]


def test_not_in_drops_null(numbers):
    assert tuples(numbers.where(where([("a", [1], "not in", "and")])), "a") == [(3,)]


def test_unknown_words_are_refused():
    with pytest.raises(ValueError):
        where([("a", 1, "~", "and")])
    with pytest.raises(ValueError):
        where([("a", 1, "=", "xor"), ("b", 1, "=", "and")])


def test_and_binds_tighter_than_or(numbers):
    # a = 1 OR (b = 2 AND c = 'x')
    items = [("a", 1, "=", "or"), ("b", 2, "=", "and"), ("c", "x", "=", "and")]
    assert tuples(numbers.where(where(items)), "b") == [(1,)]
    # (a = 1 OR b = 2) AND c = 'y'
    items = [("", [("a", 1, "=", "or"), ("b", 2, "=", "or")], "sub", "and"), ("c", "y", "=", "or")]
    assert tuples(numbers.where(where(items)), "b") == [(2,)]


def test_suffix_none_and_empty_list(numbers):
    assert items_from_kwargs(status_list=[1], age=None, uid_list=[]) == [("status", [1], "in", "and")]
    assert numbers.where(where_kwargs(a_list=[])).count() == 3
    assert numbers.where(where_kwargs(b_list=[1, 3], c="x")).count() == 1


def test_keyword_wildcards(spark):
    names = spark.createDataFrame([("a_b",), ("axb",), ("a\\xb",), ("50%",), ("ab",)], "n string")
    hit = lambda kw: [r[0] for r in tuples(names.where(contains("n", kw)))]
    assert hit("a_b") == ["a_b", "axb"]
    assert hit("50%") == ["50%"]
    assert hit("\\x") == ["a\\xb"]
    assert tuples(names.where(contains("n", "AXB", ci=True))) == [("axb",)]


def test_keyword_loses_spaces(spark):
    names = spark.createDataFrame([("LiHua", "p"), ("Li Hua", "q"), ("p", "LiHua")], "n string, m string")
    assert normalize_keyword("Li Hua") == "LiHua"
    assert names.where(keyword_filter("Li Hua", ["n"])).count() == 1
    assert names.where(keyword_filter("Li Hua", ["n", "m"])).count() == 2
    assert names.where(keyword_filter("  ", ["n"])).count() == 3


def test_order(numbers):
    assert [r.b for r in ordered(numbers, [("a", "asc")]).collect()] == [2, 1, 3]
    assert [r.b for r in ordered(numbers, [("a", "DESC")]).collect()] == [3, 1, 2]
    assert [r.b for r in ordered(numbers, "a + b desc, b").collect()] == [3, 1, 2]
    with pytest.raises(ValueError):
        direction("up")


def test_filter_reaches_the_scan(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    plan = part.where(where([("p_size", 5, ">", "and")])).select("p_name")._jdf.queryExecution().toString()
    assert "GreaterThan(p_size,5)" in plan
    assert "ReadSchema: struct<p_name:string,p_size:int>" in plan


def test_one_element_list_is_an_equality(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    plan = part.where(where_kwargs(p_size_list=[5]))._jdf.queryExecution().toString()
    assert "EqualTo(p_size,5)" in plan
    assert part.where(F.lit(True)).count() == part.count()


def test_membership_in_text_and_other_comparisons(spark):
    df = spark.createDataFrame([("a",), ("(",), ("b",), (None,)], "k string")
    found = lambda *item: tuples(df.where(where([(*item, "and")])))
    assert found("k", "('a','b')", "in") == [("a",), ("b",)]
    assert found("k", "('a','b')", "not in") == [("(",)]
    for text in ("ab", "'a','b'"):
        with pytest.raises(ValueError):
            where([("k", text, "in", "and")])
    assert found("k", "a", "not  LIKE") == [("(",), ("b",)]
    assert found("k", None, "<=>") == [(None,)]
    assert found("k", "^[ab]$", "regexp") == [("a",), ("b",)]
    assert found("k", "^[ab]$", "not regexp") == [("(",)]
