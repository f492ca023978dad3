"""Connected components of an edge list, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (node, root) for edges (u, v) of bigints: root is the least node of the node's component.

    In a round every node takes the least label of its neighbours, then its label's label, so the
    rounds grow as the logarithm of a component's diameter. A node with very many edges costs
    no task more than others: labels are joined to edges, and minima are partial aggregates.
    """
    both = scratch.write(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")), f"{name}-0")
    k = 0
    while True:
        offered = both.join(labels, both["v"] == labels["node"]).select(F.col("u").alias("node"), "root")
        least = labels.unionByName(offered).groupBy("node").agg(F.min("root").alias("root"))
        of_root = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        jumped = least.join(of_root, "root", "left").select("node", F.least("root", "further").alias("root"))
        after = scratch.write(jumped, f"{name}-{k + 1}")
        changed = after.join(labels.withColumnRenamed("root", "before"), "node").filter("root <> before").limit(1).count()
        scratch.drop(f"{name}-{k}")
        labels, k = after, k + 1
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
