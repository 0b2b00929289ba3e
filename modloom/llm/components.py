"""Connected components of an edge table, by alternating stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modloom.llm.tables import cut_lineage


def _size_and_sum(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes."""
    mixed = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mixed).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
    )
    least = cut_lineage(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "least")
    # v < u: the larger neighbours of v
    moved = edges.join(least, edges["v"] == least["x"]).select("u", F.col("m").alias("v"))
    return moved.filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least.withColumnRenamed("u", "x"), F.col("u") == F.col("x")).filter("v > m")
    kept = least.select("u", F.col("m").alias("v"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(kept).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    A round costs four shuffles of the edges; stars settle in two rounds, chains in about the
    logarithm of their length. Minima are written first, so that both sides of each join are
    plain tables whose hot keys Spark splits. Loops are ignored; no edges give no rows.
    """
    pairs = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    current = cut_lineage(pairs.distinct(), "edges")
    seen = _size_and_sum(current)
    while seen[0]:
        current = cut_lineage(_small_star(cut_lineage(_large_star(current), "edges")), "edges")
        now = _size_and_sum(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
