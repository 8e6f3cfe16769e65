"""Connected components of a graph too large for one machine.

Alternating star contraction: the large-star step hangs every larger neighbour of a node on
the smallest node around it, the small-star step does so for the smaller ones. The edges
shrink to stars around the smallest node of each component, in a number of rounds that grows
with the logarithm of the size. A node with very many neighbours is reduced by a minimum
that is taken where its edges lie. Both sides of the join that follows are written first: they
come straight from a shuffle then, which lets Spark split the edges of such a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    hung = both.where("v > u").join(least, "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """`edges` point from the larger node u to the smaller node v."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    hung = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node of an edge that is not the smallest of its component, and that smallest node.

    `edges` has two bigint columns, in either direction, repeats and loops allowed.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = written(edges, "edges")
    seen = None
    while True:
        edges = written(_small_star(written(_large_star(edges), "edges")), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges
        seen = state
