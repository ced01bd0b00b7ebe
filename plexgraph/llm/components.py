"""Connected components of an edge table, as rounds of joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.runtime import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b); label is the least node of its component.

    Each round takes the least label next to a node and then the label of that
    label, so that the rounds grow with the logarithm of a path's length in the
    usual case. An empty edge table gives an empty table.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        moved = stored(lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "was"), "labels")
        changed = moved.where("label <> was").limit(1).count()
        discard(labels)
        labels = moved.select("node", "label")
        if not changed:
            discard(both)
            return labels
