"""Degrees, classes, and the parents and children of the containment tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.graph import Graph
from undertow.runtime import shuffled


def degrees(graph: Graph) -> DataFrame:
    """(id, path, uses_in, uses_out): uses edges at each node, parallel edges counted each."""
    ends = graph.uses().select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counts = ends.groupBy("e.id").agg(F.sum("e.i").alias("uses_in"), F.sum("e.o").alias("uses_out"))
    return graph.nodes.select("id", "path").join(shuffled(counts), "id", "left").fillna(0, ["uses_in", "uses_out"])


def class_of(uses_in: Column, uses_out: Column) -> Column:
    """isolated, leaf (nobody uses it), base (it uses nothing) or intermediate."""
    return F.when((uses_in == 0) & (uses_out == 0), "isolated").when(uses_in == 0, "leaf").when(uses_out == 0, "base").otherwise("intermediate")


def classification(graph: Graph) -> DataFrame:
    return degrees(graph).withColumn("class", class_of(F.col("uses_in"), F.col("uses_out")))


def owns_parents(graph: Graph) -> DataFrame:
    """(id, parent): of several owns edges into a node, the last in edge order counts."""
    return graph.owns().groupBy(F.col("dst").alias("id")).agg(F.max_by("src", F.struct("edge_seq", "src")).alias("parent"))


def owns_children(graph: Graph) -> DataFrame:
    """(id, children): sorted paths of the owned nodes, repeats kept."""
    kids = graph.owns().join(graph.nodes.select(F.col("id").alias("dst"), "path"), "dst")
    return kids.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("path")).alias("children"))


def class_distribution(graph: Graph) -> DataFrame:
    """(class, n, uses_in): nodes and summed in-degrees of each class."""
    return classification(graph).groupBy("class").agg(F.count("*").alias("n"), F.sum("uses_in").alias("uses_in"))
