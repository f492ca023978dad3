"""Connected components of a graph, by least labels with shortcuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the folder of spark.checkpoint.dir, which all executors share."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="zonewise-"))
    return df.checkpoint()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes (node): root is the least node that edges (u, v) connect it to.

    The rounds grow as the logarithm of a component's diameter; every round's labels are checkpointed.
    """
    both = checkpointed(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
    labels = checkpointed(nodes.select("node", F.col("node").alias("root")))
    while True:
        offered = both.join(labels, both["v"] == labels["node"]).select(F.col("u").alias("node"), "root")
        least = labels.unionByName(offered).groupBy("node").agg(F.min("root").alias("root"))
        shortcut = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = checkpointed(least.join(shortcut, "root", "left").select("node", F.least("root", "further").alias("root")))
        changed = after.join(labels.withColumnRenamed("root", "before"), "node").filter("root <> before")
        if changed.isEmpty():
            return after
        labels = after
