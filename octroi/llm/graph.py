"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octroi.session import written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs; returns (node, component) for every node, component being the least node.

    Each round hooks all greater neighbours of a node, then all smaller ones, onto the least
    neighbour. Rounds grow with the logarithm of the longest chain, and a node's edges are never gathered:
    the least neighbour is an aggregate that is joined back. Each round's edges are written, so a lost
    executor costs at most one round.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    now = written(edges.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct(), "edges")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    state = print_of(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(*pair(F.col("b"), F.col("m"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(*pair(F.col("b"), F.col("m"))).union(low.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "edges")
        before, state = state, print_of(now)
        if state == before:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(now.select("b", "b").distinct())
