"""Connected components by alternating large-star and small-star steps, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, most: int = 40) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the smallest node that it reaches.

    Each step moves edges to smaller neighbours, so the edge count never exceeds the input's and a
    node with very many neighbours only ever takes part in joins and partial aggregates, which
    Spark can split. The work ends when a step changes nothing. Self-loops, repeated edges and
    an empty input are allowed.
    """
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most):
        # Large star: at each node every larger neighbour is linked to the node's smallest neighbour, or to the node if
        # it has none smaller. The smallest ones are a table of their own, so that Spark can split the edges of a hub.
        least = scratch.write(now.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b"))
        large = now.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = scratch.write(small.filter("a <> b").distinct())
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now, least)
        now = after
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
