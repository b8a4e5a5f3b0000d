"""Connected components of an undirected graph by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long). Returns (node, component): the smallest node reachable from each node.

    Only nodes with an edge to another node come back; self-loops, nulls and repeated edges add
    nothing. Each round every node takes the smallest label among itself and its neighbours, then
    the label of that label; a few rounds suffice for the star-shaped graphs met here, and a chain
    of n nodes takes about log n. Labels are written to the shared folder in each round.
    """
    edges = edges.filter("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        # Smallest neighbouring label, handed also to the node that the present label names.
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        near = labels.join(seen, labels["node"] == seen["a"]).select("node", "label", F.least("label", "low").alias("low"))
        hooks = near.filter("low < label").groupBy("label").agg(F.min("low").alias("hook")).withColumnRenamed("label", "node")
        new = near.select("node", F.col("label").alias("was"), "low").join(hooks, "node", "left").select("node", "was", F.least("low", "hook").alias("label"))
        new = materialize(new, "labels")
        up = new.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = new.join(up, "label", "left").select("node", "was", F.least("label", "above").alias("label"))
        labels = materialize(jumped, "labels")
        if labels.filter("label < was").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
