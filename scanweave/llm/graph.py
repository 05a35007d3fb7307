"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One hooking step on (a, b): every node's neighbours point at the least node around it. The large step moves the
    neighbours above the node, the small step those below it and the node itself."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    out = both.join(low, "a")
    if large:
        return out.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
    moved = out.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's least node. Steps alternate until the
    edges are stars; each round's edges are written once. Sums per node are partial before any shuffle, and joins are
    left to adaptive execution, so a node with many neighbours is no single task's work."""
    edges = written(edges.select("a", "b").filter("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        edges = written(_star(_star(edges, True), False))
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (now["n"], now["x"]) == seen:
            break
        seen = (now["n"], now["x"])
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
