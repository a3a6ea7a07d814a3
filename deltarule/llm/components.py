"""Connected components of an undirected graph, entirely in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltarule.llm.common import with_checkpoints


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) for every node of edges (a, b).

    Each round gives a node the least label among its neighbours' (a minimum that is
    combined before its shuffle, so a node with very many neighbours is no hot spot) and
    then the label of its label, which halves the way that is left. Rounds are
    checkpointed; only whether one changed anything reaches the driver.
    """
    with_checkpoints(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        joined = labels.join(near, "node", "left").select("node", "component", F.least("component", "least").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("component").alias("further"))
        after = joined.join(jump, "least", "left").select("node", F.least("least", "further").alias("component"), (F.least("least", "further") != F.col("component")).alias("moved")).checkpoint()
        labels = after.select("node", "component")
        if not after.filter("moved").limit(1).count():
            return labels
