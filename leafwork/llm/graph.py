"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import forget, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b) but roots themselves; a root is the least node of its component.

    Every step is a grouped minimum with map-side partials and an equi-join with the written minima, whose hot keys the
    runtime splits. Nodes and edges stay on the executors; the driver sees a count and a checksum each round. Rounds go on
    until nothing changes (a few, as the logarithm of the longest chain); each deletes what the one before it wrote.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct(), "edges")
    state, before = _state(now), None
    while state[0] and state != before:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large-edges")
        down = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "small-star")
        small = large.join(down, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = materialize(small.union(down.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        before, state = state, _state(after)
        forget(now, least, large, down)
        now = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


class Union:
    """Union-find over 0 .. n - 1 that keeps the least member as root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
