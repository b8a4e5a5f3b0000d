"""Many labelled graphs as one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.functions import crate_of
from undertow.graph import Graph
from undertow.operators.numbering import numbered
from undertow.runtime import materialize, shuffled, stored_once


@dataclass(frozen=True)
class Union:
    graph: Graph
    ghosts: DataFrame  # (path, referenced_by)


def _best_first() -> W:
    return W.partitionBy("path").orderBy(F.col("defines").desc(), F.col("position").isNull(), "label", "id")


def _marked(graph: Graph) -> DataFrame:
    return graph.nodes.withColumn("owner", crate_of(F.col("path"))).withColumn("defines", F.col("label") == F.col("owner"))


def chosen_nodes(graph: Graph) -> DataFrame:
    """One node for each path: a definition (its label owns the path) before a reference, then one
    with a position, then by label and id."""
    return _marked(graph).withColumn("place", F.row_number().over(_best_first())).filter("place = 1").drop("place", "owner", "defines")


def ghosts(graph: Graph) -> DataFrame:
    """(path, referenced_by): paths whose owner is among the labels but which no graph defines."""
    members = graph.nodes.select(F.col("label").alias("owner")).distinct()
    seen = _marked(graph).groupBy("path", "owner").agg(F.max("defines").alias("defined"), F.sort_array(F.collect_set("label")).alias("referenced_by"))
    return seen.filter("not defined").join(members, "owner", "left_semi").select("path", "referenced_by")


def numbered_by_path(nodes: DataFrame) -> DataFrame:
    """Replace id by the place of the path in byte order, from 0."""
    return numbered(nodes.drop("id"), ["path"], "id").select(*nodes.columns)


def unite(graph: Graph) -> Union:
    """graph: nodes and edges with a label each. Edges are linked again by path, and equal ones become one."""
    graph = graph.with_nodes(stored_once(graph.nodes, "labelled"))
    nodes = numbered_by_path(chosen_nodes(graph))
    ids = nodes.select("path", F.col("id").alias("new_id"))
    where = materialize(graph.nodes.select("label", F.col("id").alias("old_id"), "path").join(shuffled(ids), "path").select("label", "old_id", "new_id"), "numbers")
    edges = graph.edges
    for end in ("src", "dst"):
        to = where.select("label", F.col("old_id").alias(end), F.col("new_id").alias(f"new_{end}"))
        edges = edges.join(shuffled(to), ["label", end])
    edges = edges.groupBy(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "relation", "uses_kind").agg(F.min("edge_seq").alias("edge_seq"))
    return Union(Graph.of(nodes.drop("label"), edges, "workspace"), ghosts(graph))
