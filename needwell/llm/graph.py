"""Connected components by contraction: every step is a join or an aggregation that combines first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and label, the smallest node of its component, for each node of edges (a, b).

    A round points every node to its smallest neighbour, follows the pointers to their roots by
    doubling, and replaces the edges by edges between roots. Stars vanish in one round, sorted
    chains too; the edges that are left shrink to at most half in every round.
    """
    edges = staged(edges.select("a", "b").where("a != b").distinct(), name)
    mapping = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        parent = staged(parent.select("node", F.least("node", "least").alias("root")), name)
        while True:
            above = parent.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
            jumped = parent.join(above, F.col("root") == F.col("_node"))
            jumped = staged(jumped.select("node", F.col("_root").alias("root"), (F.col("root") != F.col("_root")).alias("moved")), name)
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        kept = edges.join(left, "a").join(right, "b").where("ra != rb")
        edges = staged(kept.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), name)
        if mapping is None:
            mapping = parent.withColumnRenamed("root", "label")
        else:
            later = parent.withColumnsRenamed({"node": "_node", "root": "_root"})
            mapping = mapping.join(later, F.col("label") == F.col("_node"), "left").select(
                "node", F.coalesce("_root", "label").alias("label")
            )
        mapping = staged(mapping, name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if mapping is None else mapping
