"""Groups that links make: union-find within a task, connected components over the tasks by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored, stored_at


class Links:
    """What a task has found: the weight of each point's partners, and the groups that links connect. Memory follows the points, not the links."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.sum, self.label = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def _root(self, i: int) -> int:
        while (j := self.label[i]) != i:
            self.label[i] = self.label[j]
            i = int(j)
        return i

    def add(self, i: int, others: np.ndarray) -> None:
        """Links of point i with others, which are distinct; each pair is given once."""
        self.sum[i] += self.weights[others].sum()
        self.sum[others] += self.weights[i]
        some = {self._root(int(x)) for x in np.unique(self.label[others])} | {self._root(i)}
        least = min(some)
        for x in some:
            self.label[x] = least
        self.label[others] = least

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points with links, the first point of the group of each, and the weight of its partners."""
        while not np.array_equal(up := self.label[self.label], self.label):
            self.label = up
        some = np.flatnonzero(self.sum)
        return some, self.label[some], self.sum[some]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge but the roots themselves; a root is the least node of its component.

    Each step is written to the shared folder, and the one before deleted then. Least neighbours are aggregates, combined before
    the shuffle, so a node of very many edges is no task's alone. Edges of a node with itself, nulls and repeated edges count for nothing.
    """
    e, at = stored_at(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u <> v").distinct(), "components")
    before = None
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, old = stored_at(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # v < u in every row
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct()
        e, now_at = stored_at(small, "components")
        drop(e.sparkSession, at, old)
        at = now_at
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.toDF("node", "root")
        before = now


def classes(points: DataFrame, found: DataFrame, id: str = "best") -> DataFrame:
    """points (node, w and more) with `class` (the least `id` of all points that links connect) and `links` (rows alike or near, but for itself).

    found: (a, b, n) as Links gives them, from all tasks; an equal point stands for w rows.
    """
    found = stored(found, "links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    of = links.join(components(found.select("a", "b")), "node", "left").select("node", "n", F.coalesce("root", "node").alias("group"))
    linked = stored(points.select("node", id).join(of, "node"), "linked")
    least = linked.groupBy("group").agg(F.min(id).alias("class"))
    out = points.join(linked.join(least, "group").select("node", "n", "class"), "node", "left")
    return out.withColumn("class", F.coalesce("class", id)).withColumn("links", F.col("w") - 1 + F.coalesce("n", F.lit(0))).drop("n")
