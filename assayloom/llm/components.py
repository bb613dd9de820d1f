"""Connected components of an edge table by alternating stars, each step a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayloom.llm.tables import put


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(low, both["u"] == low["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    tied = edges.join(low, edges["u"] == low["k"])
    return tied.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(
        F.col("e.u").alias("u"), F.col("e.m").alias("v"),
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (u, v): component is the smallest id reachable. Loops are dropped.

    Each round is written to the shared folder; rounds grow with the logarithm of the largest component.
    """
    edges = put(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        edges = put(_small_star(_large_star(edges)).where("u != v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct()
