"""Connected components of a graph given as edges, by passing on the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the smallest node of its component.

    Each round a node takes the smallest label among its neighbours, and then that label's own label, so that chains halve.
    Labels only shrink; the rounds end when none does. Messages to a node are reduced before they move.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    both = cut_lineage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        told = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        heard = labels.join(told, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("near"))
        of_label = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        now = cut_lineage(heard.join(of_label, "near").select("node", "was", F.least("near", "far").alias("label")))
        labels = now.select("node", "label")
        if now.where("label < was").isEmpty():
            return labels
