"""Connected components by alternating large and small stars, each round a join-free aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every node's larger (or smaller) neighbours on the smallest node of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("low"))
    joined = both.join(low, "a")
    moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")) if large else joined.select("b", "low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, group_id) with the smallest node of each component; edges (a, b)."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(ROUNDS):
        after = materialize(_star(_star(edges, True), False), "star")
        # a fixed point has every node hung on one root that hangs on none
        if after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty():
            break
        edges = after
    else:
        raise RuntimeError(f"components don't settle in {ROUNDS} rounds")
    edges = after
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("group_id"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("group_id")).unionByName(roots)
