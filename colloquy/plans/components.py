"""Connected components of links, as DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) for the ends of the links (a, b).

    Each round a node takes the smallest label among its neighbours' and its own, and then the label of
    that label, so chains halve. Rounds end when no label changes.
    """
    edges = links.select("a", "b").where("a <> b")
    edges = checkpointed(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        offered = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        lower = labels.join(offered, "node").select("node", F.col("component").alias("before"), F.least("component", "offer").alias("component"))
        onward = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        settled = checkpointed(lower.join(onward, "component").select("node", "before", F.least("component", "next").alias("component")))
        labels = settled.select("node", "component")
        if settled.where("component <> before").isEmpty():
            return labels
