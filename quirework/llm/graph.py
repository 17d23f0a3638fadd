"""Connected components by contraction, on tables that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b: long); root is the same for all nodes of a component, and one of them.

    Each round moves every node to the neighbour with the least hash, if that is less than its own, and keeps the edges
    between different targets: a constant share of the nodes goes with each round, whatever the order of their ids.
    Counts are summed before shuffles; the joins are between written tables, so that Spark splits a node with very
    many edges. A round's table is written, and rounds end when no edge is left.
    """
    levels: list[DataFrame] = []
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c).alias("node"))
    left = materialised(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        parent = materialised(best.select(F.col("a").alias("node"), F.least(rank("a"), F.col("best"))["node"].alias("to")), "parents")
        levels.append(parent)
        a, b = (parent.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = left.join(a, "a").join(b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        left = materialised(moved.filter("a <> b").distinct(), "edges")
    if not levels:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    root = levels[-1].select("node", F.col("to").alias("root"))
    for parent in reversed(levels[:-1]):
        up = root.select(F.col("node").alias("to"), "root")
        root = parent.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return root
