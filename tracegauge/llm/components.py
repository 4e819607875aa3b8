"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) of every node of edges(a, b); the component's name is its smallest node.

    Each round hooks all neighbours of a node, larger ones first and then smaller ones too, to the smallest
    node among them.  Every round works on distinct edges and pre-aggregates the minima, so that a node with
    very many neighbours is not gathered in one task; rounds go on until the edges stay the same (by their
    number and two sums of hashes).  ``rows``: about how many edges there are.
    """
    current = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows)
    seen = None
    while (now := _print(current)) != seen:
        seen = now
        # larger neighbours of u, and u, go to u's smallest neighbour
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct(), rows)
        # smaller neighbours of u, and u, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = durable(small.union(least.select("u", F.col("m").alias("v"))).distinct(), rows)
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _print(edges: DataFrame) -> tuple:
    h = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), h(1), h(2)).first())
