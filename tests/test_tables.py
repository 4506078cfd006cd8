from rollbook.operators import tables


def test_tables_are_written_once_and_removed(spark):
    start = tables.mark()
    one = tables.kept(spark.range(3), "one")
    middle = tables.mark()
    two = tables.kept(one.selectExpr("id * 2 AS id"), "two")
    assert [r[0] for r in two.orderBy("id").collect()] == [0, 2, 4]
    written = tables.tables()
    tables.remove(spark, start, middle)
    assert tables.tables() == [p for p in written if "/one-" not in p] and two.count() == 3
    tables.remove(spark, start)
    assert not any("/two-" in p for p in tables.tables())
