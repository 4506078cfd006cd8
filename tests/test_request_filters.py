import pytest
from conftest import tuples
from pyspark.sql import functions as F

from rollbook.functions.predicates import where_kwargs
from rollbook.operators import request_filters, tables
from rollbook.operators.request_filters import match_filters

COLUMNS = ["class_uid", "age", "name", "score"]
FILTERS = "filter_id bigint, terms map<string,array<string>>, keyword string, match_range array<string>, key string"


@pytest.fixture(scope="module")
def pupils(spark):
    rows = spark.range(240).select(
        F.col("id").alias("uid"), (F.col("id") % 7).cast("int").alias("class_uid"), F.when(F.col("id") % 5 != 0, F.col("id") % 11).alias("age"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("pu_pil 50% "), F.col("id").cast("string"))).alias("name"),
        (F.col("id") % 4).cast("decimal(15,2)").alias("score"), F.lit("x").alias("terms"), F.lit("y").alias("_row"),
    )
    return rows.persist()


def filters_of(spark, *filters):
    return spark.createDataFrame([(*f, "clash") for f in filters], FILTERS)


def test_a_thousand_filters_match_as_columns_do(spark, pupils):
    asked, wanted = [], []
    for i in range(1000):
        terms, kwargs = {}, {}
        if i % 2:
            terms["class_uid"], kwargs["class_uid"] = [str(i % 9)], i % 9
        if i % 3 == 0:
            ages = [i % 11, i % 6, None][: 1 + i % 3 + i % 2]
            terms["age_list"], kwargs["age_list"] = [None if a is None else str(a) for a in ages], [a for a in ages if a is not None]
        if i % 5 == 0:
            terms["score"], kwargs["score"] = [str(i % 4)], i % 4
        word, within = ("%d" % (i % 23), ["name"]) if i % 4 == 0 else (None, None)
        if word:
            kwargs.update(keyword=word, match_range=within)
        asked.append((i, terms, word, within))
        wanted.append(kwargs)
    got = match_filters(filters_of(spark, *asked), pupils, "uid", COLUMNS)
    pairs = {}
    for f, uid in got.rows.collect():
        assert uid not in pairs.setdefault(f, set())
        pairs[f].add(uid)
    distinct = {repr(sorted(k.items())): k for k in wanted}
    truth = pupils.agg(*[F.collect_set(F.when(where_kwargs(**k), F.col("uid"))).alias(str(n)) for n, k in enumerate(distinct.values())]).first()
    told = {text: set(truth[n]) for n, text in enumerate(distinct)}
    assert len(distinct) > 200
    for i, kwargs in enumerate(wanted):
        assert pairs.get(i, set()) == told[repr(sorted(kwargs.items()))], kwargs
    assert dict(got.counts.collect()) == {i: len(pairs.get(i, ())) for i in range(1000)}
    assert got.rejected.count() == 0


def test_nothing_asked_unknown_columns_and_odd_values(spark, pupils):
    got = match_filters(
        filters_of(
            spark,
            (1, None, None, None), (2, {"age_list": []}, "  ", ["name"]), (3, {"age": None}, "5", []),  # no filter at all
            (4, {"grade": ["1"]}, None, None), (5, {}, "1", ["name", "title"]), (None, {}, None, None),
            (6, {"age": ["old"]}, None, None), (7, {"score": ["3.0"], "class_uid": ["3"]}, None, None), (8, {"age": [None]}, None, None),
            (9, {}, "50% 2", ["name"]), (10, {}, "u_p", ["name"]), (11, {}, "\\", ["name"]),
        ),
        pupils, "uid", COLUMNS,
    )
    counts = dict(got.counts.collect())
    named = [i for i in range(240) if i % 13]
    assert [counts[i] for i in (1, 2, 3)] == [240] * 3
    assert (counts[6], counts[8], counts[11]) == (0, 0, 0)
    assert counts[7] == len([i for i in range(240) if i % 4 == 3 and i % 7 == 3])
    assert counts[9] == len([i for i in named if "2" in str(i)]) and counts[10] == len(named)
    assert tuples(got.rejected) == [(None, "no_id"), (4, "unknown_column"), (5, "unknown_column")]
    assert got.rows.columns == ["filter_id", "uid"] and got.rows.where("filter_id = 2").count() == 240


def test_rows_of_one_id_are_alternatives(spark, pupils):
    one = (1, {"class_uid": ["2"]}, None, None)
    got = match_filters(
        filters_of(spark, one, one, (1, {"age": ["3"]}, None, None), (2, {"class_uid": ["2"], "class_uid_list": ["3"]}, None, None),
                   (3, {"class_uid": ["2"]}, None, None), (3, {"grade": ["2"]}, None, None), (4, {"age": ["3"]}, None, None), (4, {}, None, None)),
        pupils, "uid", COLUMNS,
    )
    chosen = [i for i in range(240) if i % 7 == 2 or (i % 5 and i % 11 == 3)]
    assert sorted(r.uid for r in got.rows.where("filter_id = 1").collect()) == chosen
    assert dict(got.counts.collect()) == {1: len(chosen), 2: 0, 4: 240}
    assert tuples(got.rejected) == [(3, "unknown_column")]


def test_empty_tables_and_rows_without_a_key(spark, pupils):
    none = filters_of(spark, *[(1, {}, None, None)]).limit(0)
    got = match_filters(none, pupils, "uid", COLUMNS)
    assert got.rows.count() == got.counts.count() == got.rejected.count() == 0
    asked = filters_of(spark, (1, {}, None, None), (2, {"age": ["3"]}, None, None), (3, {}, "1", ["name"]))
    assert dict(match_filters(asked, pupils.limit(0), "uid", COLUMNS).counts.collect()) == {1: 0, 2: 0, 3: 0}
    keyless = pupils.withColumn("uid", F.when(F.col("uid") >= 200, F.col("uid")))
    assert dict(match_filters(asked, keyless, "uid", COLUMNS).counts.collect())[1] == 40


def test_no_row_meets_every_filter(spark, pupils, monkeypatch):
    """Neither a cross join nor a Python worker in anything that is written on the way: candidates come by an equi-join."""
    plans = []

    def spied(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return tables.kept(df, name)

    monkeypatch.setattr(request_filters, "kept", spied)
    got = match_filters(filters_of(spark, (1, {"age": ["3"]}, "1", ["name"]), (2, {}, None, None), (3, {}, "7", ["name"])), pupils, "uid", COLUMNS)
    plans.append(got.rows._jdf.queryExecution().toString())
    assert len(plans) == 5
    for plan in plans:
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_counts_and_extremes_without_a_pair_of_filter_and_row(spark, monkeypatch):
    """Many filters that ask for the same and many rows that are alike: what is written on the way has a row per ask and kind, not per pair."""
    written = {}

    def spied(df, name):
        written[name] = tables.kept(df, name)
        return written[name]

    monkeypatch.setattr(request_filters, "kept", spied)
    rows = spark.range(400).select(F.col("id").alias("uid"), (F.col("id") % 4).alias("class_uid"), F.concat(F.lit("n"), F.col("id") % 10).alias("name"))
    asked = [(i, {"class_uid": [str(i % 5)]} if i % 2 else {}, "3" if i % 3 == 0 else None, ["name"]) for i in range(300)]
    got = match_filters(filters_of(spark, *asked), rows.union(rows.where("uid < 9")), "uid", ["class_uid", "name"])
    pairs = [(f, uid) for f, terms, word, _ in asked for uid in range(400) if (not terms or uid % 4 == f % 5) and (word is None or uid % 10 == 3)]
    assert tuples(got.rows) == tuples(spark.createDataFrame(pairs, "a bigint, b bigint"))
    of = {}
    for f, uid in pairs:
        of.setdefault(uid, []).append(f)
    assert sorted(tuple(r) for r in got.chosen.collect()) == sorted((u, len(fs), min(fs), max(fs)) for u, fs in of.items())
    assert written["filter-pairs"].count() < 100 < len(pairs) / 100


def test_rows_of_one_key_count_once(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, None), (2, 1, None), (None, 1, "a")], "uid bigint, class_uid int, name string")
    got = match_filters(filters_of(spark, (1, {"class_uid": ["1", "2"]}, None, None), (2, {"class_uid": ["1"]}, "a", ["name"]), (3, {}, None, None)), rows, "uid", ["class_uid", "name"])
    assert dict(got.counts.collect()) == {1: 2, 2: 1, 3: 2}
    assert sorted(tuple(r) for r in got.chosen.collect()) == [(1, 3, 1, 3), (2, 2, 1, 3)]
