import random

from rollbook.llm.components import Forest, connected_components


def brute(links):
    forest = Forest()
    for a, b in links:
        if a is not None and b is not None and a != b:
            forest.join(a, b)
    return {x: forest.root(x) for x in forest.above}


def test_random_graphs_chains_and_stars(spark):
    rng = random.Random(1)
    cases = [[(rng.randint(-50, 50), rng.randint(-50, 50)) for _ in range(60)], [(i, i + 1) for i in range(64)], [(0, i) for i in range(1, 200)], [(1, 1), (None, 2), (3, None)], []]
    for links in cases:
        df = spark.createDataFrame([(*x, "x") for x in links], "a bigint, b bigint, component string").repartition(5)
        rows = connected_components(df).collect()
        assert {r["node"]: r["component"] for r in rows} == brute(links)
        assert len(rows) == len({r["node"] for r in rows})
