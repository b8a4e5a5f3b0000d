"""Weakly connected components: who is linked with whom, whatever the direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.runtime import materialize, materialize_counted


def weak_components(edges: DataFrame) -> DataFrame:
    """edges: (src, dst) of any type with an order. Returns (node, weak): the least node of each node's component.

    Nodes without an edge to another node are absent. Each round, a node takes the least label around
    it and hands that to the node which its own label names; then labels of labels are taken. That
    halves long ways, so rounds grow with the logarithm of the diameter.
    """
    far = edges.filter("src != dst").select("src", "dst")
    both = materialize(far.unionByName(far.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "ways")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("weak")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("dst"), "weak"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("weak").alias("low"))
        near = labels.join(around, "node").select("node", "weak", F.least("weak", "low").alias("low"))
        handed = near.filter("low < weak").groupBy(F.col("weak").alias("node")).agg(F.min("low").alias("handed"))
        new = near.join(handed, "node", "left").select("node", F.col("weak").alias("was"), F.least("low", "handed").alias("weak"))
        new = materialize(new, "labels")
        jump = new.select(F.col("node").alias("weak"), F.col("weak").alias("above"))
        moved = new.join(jump, "weak").select("node", F.least("weak", "above").alias("weak"), (F.least("weak", "above") < F.col("was")).alias("moved"))
        labels, n = materialize_counted(moved, "labels", moved=F.count_if("moved"))
        labels = labels.select("node", "weak")
        if not n["moved"]:
            return labels
