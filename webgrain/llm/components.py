"""Connected components by alternating large and small stars.

Each task first contracts its own edges. What is left is united by one task if its edges are within a bound;
beyond it, rounds rewrite the edges so that nodes point at smaller ones: only aggregates with map-side combining and
joins whose two sides are plain exchanges (which adaptive execution splits when a hub is hot) take part, and
every round is cut from its lineage in the shared folder. Nothing is collected but two sums per round.
Both ways give the same components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Stage


#: That many edges at most are united by one task, which holds a few hundred bytes for each.
ONE_TASK_EDGES = 1 << 19


class _Forest:
    """Union-find whose roots are the smallest nodes."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def add(self, pdf) -> None:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)


def _local(parts):
    """One batch's edges: (node, its smallest node here), at most as many rows as edges came in."""
    import pandas as pd

    for pdf in parts:
        forest = _Forest()
        forest.add(pdf)
        nodes = [x for x in list(forest.parent) if forest.find(x) != x]
        yield pd.DataFrame({"a": nodes, "b": [forest.find(x) for x in nodes]}, dtype="int64")


def _united(parts):
    import pandas as pd

    forest = _Forest()
    for pdf in parts:
        forest.add(pdf)
    nodes = list(forest.parent)
    yield pd.DataFrame({"node": nodes, "component": [forest.find(x) for x in nodes]}, dtype="int64")


def connected_components(spark: SparkSession, edges: DataFrame, stage: Stage, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """edges (a long, b long) -> staged (node long, component long): the smallest node reachable, for nodes with an edge.

    Null ends and loops are ignored; repeated edges count once. An empty table gives an empty one.
    """
    pair = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b")
    now = stage.put(pair.mapInPandas(_local, "a long, b long"), "edges")
    if now.count() <= one_task:
        stars = now.coalesce(1).mapInPandas(_united, "node long, component long")
        return stage.put(stars, "components")
    last = None
    while True:
        both = now.union(now.select("b", "a"))
        low = stage.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")), "low")
        large = stage.put(both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        stage.drop(now, low)
        low = stage.put(large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")), "low")
        met = large.join(low, F.col("a") == F.col("k"))
        now = stage.put(met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("k", "m")).distinct(), "small")
        stage.drop(large, low)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not sums[0]:
            break
        if sums == last:
            break
        last = sums
    return _named(stage, now)


def _named(stage: Stage, stars: DataFrame) -> DataFrame:
    out = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    return stage.put(out, "components")
