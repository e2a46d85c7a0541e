"""Connected components over an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """``node`` and ``component``, the smallest node it reaches, for all nodes that have an edge.

    Each round, a node goes to that of itself and its neighbours whose hash (another one each round) is the smallest, and
    the edges between what they went to are the next round's: about half of the nodes, and no edge within a settled
    component.  Steps and edges are written to the shared folder each round; nothing but a count reaches the driver.
    """
    ends = F.col(a).alias("a"), F.col(b).alias("b")
    links = materialise(edges.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).filter("a != b").distinct(), "links")
    steps: list[DataFrame] = []
    while not links.isEmpty() or not steps:
        if len(steps) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")

        def rank(node: str, k: int = len(steps)) -> Column:
            return F.struct(F.xxhash64(F.lit(k), node).alias("h"), F.col(node).alias("to"))

        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        nearest = both.groupBy("node").agg(F.min(rank("other")).alias("near"))
        steps.append(materialise(nearest.select("node", F.least(rank("node"), "near")["to"].alias("to")), "labels"))
        moved = links.join(steps[-1].toDF("a", "x"), "a").join(steps[-1].toDF("b", "y"), "b").filter("x != y")
        before, links = links, materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        release(before)
    labels = steps[-1]
    for step in steps[-2::-1]:
        before, labels = labels, step.join(labels.toDF("to", "further"), "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        labels = materialise(labels, "labels")
        release(before, step)
    lowest = labels.groupBy("to").agg(F.min("node").alias("component"))
    found = materialise(labels.join(lowest, "to").select("node", "component"), "labels")
    release(labels, links)
    return found
