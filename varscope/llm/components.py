"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large) or not larger (small) neighbours to its least neighbour."""
    if large:
        sym = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sym = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "_a")
    hung = sym.join(least, F.col("a") == F.col("_a"))
    if large:
        out = hung.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the distinct edges (a, b), a > b, are stars: each ``a`` has one neighbour, which has no smaller one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("top")).filter("up > 1 or (up = 1 and top = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, label): the least node reachable. Nodes without links are not in it.
    Every pass is written to the shared folder; the number of passes grows with the logarithm of the nodes."""
    edges = written(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(edges):
        edges = written(_star(_star(edges, large=True), large=False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b"), F.col("b"))).distinct()
