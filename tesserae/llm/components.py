"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import shared


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m the least of u and its neighbours v. Aggregated, then joined: a vertex with very
    many neighbours is combined before the shuffle, and AQE divides it in the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex that isn't the least of its component; edges has (u, v) of longs.

    Large stars, then small stars, until nothing changes: O(log n) rounds in practice, with edges
    that never grow in number. Each round is kept in the shared folder. Loops and repeats don't matter;
    no edges give no rows.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = shared.cut(now), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        star = _least(large)
        small = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        now = shared.cut(small.distinct())


class Forest:
    """Components of a bounded set of points 0..n-1, edges added by the block."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        apart = a != b
        if not apart.any():
            return
        key = np.unique(np.minimum(a[apart], b[apart]) * len(self.label) + np.maximum(a[apart], b[apart]))
        low, high = key // len(self.label), key % len(self.label)
        parent = np.arange(len(self.label))
        while True:
            x, y = parent[low], parent[high]
            if (x == y).all():
                break
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
        self.label = parent[self.label]
