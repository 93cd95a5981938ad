"""Connected components of an edge table by alternating large and small stars.

Every round is joins and aggregations with map-side combining; only a row count
and a checksum of the edges come to the driver. Each round is written to the
shared folder, so lost executors cost no more than a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each neighbour above a node to the least of the node and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its neighbours below to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: bigint) to (node, component): the least node reachable. Nodes without edges are absent."""
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = None
    while (now := print_of(edges)) != before and now[0]:
        before = now
        edges = materialize(_small_star(_large_star(edges)), "edges")
    nodes = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
