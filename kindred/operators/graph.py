"""Cliques: connected components of a graph given as edges, by rounds of large-star and small-star.

Kiveris et al., "Connected components in MapReduce and beyond" (SoCC 2014). Each round is grouping and joining of edges; it
needs neither a driver-side graph nor a partition that holds a component. Rounds grow with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Shared


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", node: str = "node", root: str = "root") -> DataFrame:
    """(node, root) for every node of an edge between different nodes; root is the component's smallest node.

    Edges with a null end and edges from a node to itself are ignored; repeated edges and either direction are the same.
    """
    work = Shared(edges.sparkSession, "components")
    last, now = None, work.written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "round0")
    at = 0
    while True:
        size = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if size == last or size[0] == 0:
            return now.select(F.col("a").alias(node), F.col("b").alias(root)).union(now.select(F.col("b").alias(node), F.col("b").alias(root)).distinct())
        at += 1
        last, now = size, work.written(_small_star(_large_star(now)), f"round{at}")
        work.dropped(f"round{at - 1}")
