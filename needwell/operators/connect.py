"""Connected groups of rows from pairs, by stars: every step is a join on a node or an aggregation that combines first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needwell.session import staged


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b) with the larger, or else the smaller neighbours of each node tied to its smallest one instead."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = both if large else edges
    least = own.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = own.join(least, "a")
    if large:
        moved = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = tied.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def connected(pairs: DataFrame) -> DataFrame:
    """node, label (smallest node of the group) of every node of pairs (a, b); label itself is left out.

    Large and small stars take turns until nothing moves, in about log(n) squared rounds at most: groups then
    are stars around their smallest node. Each round is written down, none is kept in memory.
    """
    ends = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = staged(ends.where("a != b").distinct(), "edges")
    before = None
    while (mark := _mark(edges)) != before:
        before = mark
        edges = staged(_starred(_starred(edges, large=True), large=False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over their hashes: alike if no edge has moved."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
