"""Connected components of a graph that is held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node that has an edge. ``edges`` has two long columns a and b.

    Alternates large-star and small-star steps until nothing changes. A node's smallest neighbour comes from a pre-aggregated
    minimum that is joined back, so that the neighbours of a node are never collected.
    """

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        lows = pairs.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
        out = pairs.join(lows, "a")
        if small:
            out = out.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        else:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return out.where("a <> b").distinct()

    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = stash(star(star(both, False), True))
        now = mark(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select("b", "b").distinct())
