import pytest
from conftest import tuples

from rollbook.operators.access import scoped_read
from rollbook.operators.aggregation import group_agg
from rollbook.operators.lookup import exists_check, lookup, not_in_keys, profiles, semi_keys


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame(
        [("c1", "One", 1), ("c2", "Two", 0), (None, "Nowhere", 1)],
        "class_uid string, class_name string, status int",
    )


def test_lookup_misses_read_empty(spark, classes):
    rows = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, "c9"), (4, None)], "id int, class_uid string")
    got = lookup(rows, classes, "class_uid", "class_name")
    assert tuples(got, "id", "class_name") == [(1, "One"), (2, "Two"), (3, ""), (4, "")]


def test_lookup_keeps_the_row_count(spark, classes):
    rows = spark.createDataFrame([(i, "c1") for i in range(5)], "id int, class_uid string")
    doubled = classes.union(classes)
    assert lookup(rows, doubled, "class_uid", "class_name").count() == 5


def test_profiles(spark, classes):
    students = spark.createDataFrame(
        [("s1", "Ann", "c1"), ("s2", "Bob", None), ("s3", "Cid", "c9")],
        "student_uid string, student_name string, class_uid string",
    )
    teachers = spark.createDataFrame([("t1", "Tom")], "teacher_uid string, teacher_name string")
    assert tuples(profiles(students, teachers, classes)) == [
        ("student", "s1", "One Ann"),
        ("student", "s2", " Bob"),
        ("student", "s3", " Cid"),
        ("teacher", "t1", "Tom"),
    ]


def test_key_sets(spark, classes):
    keys = spark.createDataFrame([("c1",), ("c1",), (None,)], "class_uid string")
    assert tuples(semi_keys(classes, keys, "class_uid", ["class_name"])) == [("One",)]
    assert semi_keys(classes, keys.limit(0), "class_uid").count() == 0
    assert tuples(not_in_keys(classes, keys, "class_uid"), "class_name") == [("Two",)]


def test_exists_ignores_status(spark, classes):
    asked = spark.createDataFrame([(1, "c2"), (2, "c9")], "id int, class_uid string")
    assert tuples(exists_check(asked, classes, ["class_uid"]), "id", "exists") == [(1, True), (2, False)]


def test_scoped_read(spark):
    courses = spark.createDataFrame(
        [("t1", 1), ("t1", 1), ("t1", 0), ("t2", 1)], "teacher_uid string, status int"
    )
    asked = spark.createDataFrame(
        [
            (1, "teacher", "t1", "course"),
            (2, "student", "t1", "course"),
            (3, "teacher", "t9", "course"),
            (4, "teacher", "t9", "class"),
            (5, "admin", "t1", "course"),
            (6, None, "t1", "course"),
        ],
        "id int, identity string, user_uid string, resource string",
    )
    tables = {"course": courses, "class": courses}
    assert tuples(scoped_read(asked, tables), "id", "allowed", "visible") == [
        (1, True, 2),
        (2, False, 0),
        (3, True, 0),
        (4, True, 3),
        (5, False, 0),
        (6, False, 0),
    ]


def test_group_and_having(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    got = group_agg(df, "k", ["sum(v) AS total", "count(*) AS n"], having="n > 1")
    assert tuples(got) == [("a", 3, 2)]
