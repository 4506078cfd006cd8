"""Connected components of a graph given as a table of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators.joins import left_join
from rollbook.operators.tables import kept


class Forest:
    """Union-find over whole numbers; the smallest of a tree is its root."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
            self.above.setdefault(min(a, b), min(a, b))

    def links(self) -> tuple[list[int], list[int]]:
        """A link from each node to its root."""
        nodes = [x for x in self.above if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]


#: Links that a task joins into trees at a time.
FOREST_LINKS = 1_000_000


def forests(links: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` of each task replaced by as few that connect the same nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, n = Forest(), 0

        def told() -> pa.RecordBatch:
            nodes, roots = forest.links()
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            n += batch.num_rows
            if n >= FOREST_LINKS:
                yield told()
                forest, n = Forest(), 0
        yield told()

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of the links ``a``, ``b`` (whole numbers).

    Each task first thins its links to trees. Then two steps alternate until nothing changes: every node's larger
    neighbours are linked to its smallest one (large star), and every node's smaller neighbours likewise
    (small star). Minima are combined before the shuffle and joins can split hot nodes. Each round's links are
    a table in the shared folder, so a lost executor costs one round at most. Links with a null end or to itself add nothing;
    without links the result is empty.
    """
    pairs = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a is not null and b is not null and a <> b")
    current = kept(_ordered(forests(pairs)), "links")
    state = _mark(current)
    while state[0]:
        current = kept(_small_star(_large_star(current)), "links")
        before, state = state, _mark(current)
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node ``a`` to the smaller ``b``."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    """Number and sum of hashes: equal only if the links are."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame) -> DataFrame:
    """Link each ``a`` to the smallest neighbour of its ``b``."""
    both = links.select(F.col("b").alias("x"), F.col("a").alias("y")).unionAll(links.select(F.col("a").alias("x"), F.col("b").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("b"), F.least("x", "m").alias("m"))
    return _ordered(left_join(links, least, ["b"]).select("a", F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Link each ``a`` and its smaller neighbours to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    met = left_join(links, least, ["a"])
    return _ordered(met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))))
