"""Connected components of a link table by rounds of combinable minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b): the smallest node reachable.

    A round gives every node the least label among its neighbours, then the label of
    that label, so that chains shorten by halves. Labels and links stay tables in shared
    storage; only the number of changed labels reaches the driver.
    """
    edges = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        lower = labels.join(near, "node").select(
            "node", F.col("component").alias("_was"),
            F.least("component", "_near").alias("_at"))
        jump = labels.select(F.col("node").alias("_at"), F.col("component").alias("_far"))
        after = cut_lineage(lower.join(jump, "_at", "left").select(
            "node", "_was", F.least("_at", F.coalesce("_far", "_at")).alias("component")))
        changed = after.where(F.col("component") != F.col("_was")).limit(1).count()
        labels = after.drop("_was")
        if not changed:
            return labels
