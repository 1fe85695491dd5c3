"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairjudge.llm.common import written


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node``, ``root`` (smallest node of the component) of every node that has a link.

    Alternates large-star and small-star steps until nothing changes: the number of rounds grows with
    the logarithm of the graph's size, and no step gathers a node's neighbours in a list. Each
    round is a written table, so a lost executor repeats one round at most.
    """
    edges = (links.where(F.col(left) != F.col(right))
             .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct())
    edges = written(edges, "links")
    state = None
    while True:
        edges = written(_small_star(_large_star(edges)), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    # Now every edge leads from a node to its root.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _star(directed: DataFrame) -> DataFrame:
    """Link every neighbour ``b`` of ``a`` to the smallest of ``a`` and its neighbours."""
    least = directed.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return directed.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
        edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    out = _star(both).where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    starred = _star(down)
    out = (starred.select(F.col("b").alias("u"), F.col("m").alias("v"))
           .unionByName(starred.select(F.col("a").alias("u"), F.col("m").alias("v"))))
    return out.where("u <> v").distinct()
