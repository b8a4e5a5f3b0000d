"""Measurements over graphs: what a node or a kind of edge does to the cycles, kinds, ancestors, light nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.graph import Graph
from undertow.operators.degrees import owns_parents
from undertow.operators.filters import without
from undertow.operators.ranking import reach_sizes
from undertow.operators.reach import reach
from undertow.runtime import materialize, shuffled


def without_node(graph: Graph, path: str) -> Graph:
    """The graph without the node of that path and without its edges; unchanged if there is none."""
    return without(graph, graph.nodes.filter(F.col("path") == path))


def cycle_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, cyclic_before, cyclic_after) of all nodes that are in a cycle in either set of components."""

    def cyclic(parts: DataFrame, name: str) -> DataFrame:
        many = parts.groupBy("label").agg(F.count("*").alias("size")).filter("size >= 2").select("label")
        return parts.join(many, "label", "left_semi").select("path", F.lit(True).alias(name))

    both = cyclic(before, "cyclic_before").join(cyclic(after, "cyclic_after"), "path", "full")
    return both.fillna(False, ["cyclic_before", "cyclic_after"])


def kind_distribution(before: Graph, after: Graph) -> DataFrame:
    """(kind, n_before, n_after) over all nodes of two graphs."""
    kinds = before.nodes.select("kind", F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(after.nodes.select("kind", F.lit(0), F.lit(1)))
    return kinds.groupBy("kind").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))


def ancestors(graph: Graph, targets: DataFrame) -> DataFrame:
    """(target, node, depth): the owners above each of targets(id), the nearest at depth 1. A ring of owners ends at the target."""
    up = owns_parents(graph).select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    return reach(up, targets.select(F.col("id").alias("target"), F.col("id").alias("node")), "upstream")


def light_nodes(graph: Graph) -> DataFrame:
    """Nodes that carry nothing but a name: no position, trait, condition or modifier, and public."""
    empty = F.lit(True)
    for c in ("position", "trait", "trait_ref", "cfg", "macro_kind"):
        empty &= F.col(c).isNull()
    for c in ("is_const", "is_async", "is_unsafe", "is_non_exhaustive"):
        empty &= ~F.col(c)
    return graph.nodes.filter(empty & (F.col("visibility") == "pub"))


def file_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, side): files that only the first or only the second of two readers names."""
    a, b = first.select("file").distinct(), second.select("file").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionAll(b.exceptAll(a).withColumn("side", F.lit("second")))


def radius_deltas(local: Graph, whole: Graph, targets: DataFrame) -> DataFrame:
    """(path, direction, n_local, n_whole, change): how much further each of targets(path) reaches in the whole graph."""

    def sizes(graph: Graph, name: str) -> DataFrame:
        ids = materialize(graph.nodes.join(shuffled(targets.select("path").distinct()), "path", "left_semi").select("id", "path"), "ids")
        found = reach_sizes(graph, ids).withColumnRenamed("n", name)
        return found.join(shuffled(ids.withColumnRenamed("id", "target")), "target").drop("target")

    deltas = sizes(local, "n_local").join(shuffled(sizes(whole, "n_whole")), ["path", "direction"])
    return deltas.withColumn("change", F.col("n_whole") - F.col("n_local"))
