"""Hot keys: one course, student or name with most of the rows."""

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from rollbook.operators.folds import upsert_scores
from rollbook.operators.lookup import exists_check, lookup, semi_keys

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_tasks(spark):
    """Thresholds small enough for the skew join to show on a few thousand rows."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield spark
    for name in SETTINGS:
        spark.conf.unset(name)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark):
    """40,000 rows: half on key 7, a quarter without a key."""
    i = F.col("id")
    key = F.when(i % 4 == 0, None).when(i % 4 == 1, i % 1000).otherwise(7)
    return spark.range(0, 40000, 1, 8).select("id", key.alias("k"), F.md5(i.cast("string")).alias("text"))


def test_hot_key_is_split(small_tasks):
    rows = hot_rows(small_tasks)
    names = small_tasks.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    looked_up = lookup(rows, names, "k", "name")
    assert "skew=true" in final_plan(looked_up)
    assert looked_up.where("name = 'n7'").count() == 20000
    assert looked_up.where("name = ''").count() == 10000
    for flagged in (semi_keys(rows, names, "k"), exists_check(rows, names, ["k"])):
        assert "skew=true" in final_plan(flagged)


def test_rows_without_a_key_are_spread(small_tasks):
    rows = hot_rows(small_tasks).where("k is null")
    names = small_tasks.range(10).select(F.col("id").alias("k"), F.lit("x").alias("name"))
    sizes = lookup(rows, names, "k", "name").groupBy(F.spark_partition_id()).count()
    assert sizes.agg(F.max("count")).first()[0] < 5000


def test_hot_score_key_combines_before_the_shuffle(spark):
    keyed = spark.range(0, 20000, 1, 8).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds("id").alias("ts"),
        F.when(F.col("id") % 2 == 0, "create").otherwise("patch").alias("op"),
        F.lit("c").alias("course_uid"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("student_uid"),
        F.col("id").cast("double").alias("score"),
    )
    state = spark.createDataFrame(
        [], "course_uid string, student_uid string, score double, status int, created timestamp, updated timestamp"
    )
    fold = upsert_scores(state, keyed)
    assert tuples(fold.table.where("student_uid = 'hot'"), "score", "status") == [(19999.0, 1)]
    plan = fold.table._jdf.queryExecution().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_made_rows_are_ranked_from_a_table(spark, monkeypatch):
    from rollbook.operators import ranking, tables

    written = []
    monkeypatch.setattr(ranking, "kept", lambda df, name: written.append(name) or tables.kept(df, name))
    rows = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).groupBy("k", "v").count()
    plain, made = (ranking.key_rank(rows, ["k"], ("v", "desc"), "v", made=m).select("k", "v", "pos") for m in (False, True))
    assert written == ["ranked-rows"] and sorted(map(tuple, plain.collect())) == sorted(map(tuple, made.collect()))
