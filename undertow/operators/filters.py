"""Filters over whole graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.functions import crate_of, member_name
from undertow.graph import Graph
from undertow.schema import SYSROOT, GraphError, UntypedUses


def is_sysroot(path: Column) -> Column:
    """Whether the first segment, as a whole, names a sysroot crate."""
    return crate_of(path).isin(*SYSROOT)


def without(graph: Graph, removed: DataFrame) -> Graph:
    """Drop nodes and the edges that touch them.

    Both sides are shuffled, and a task keeps the removed ids of its share in a hash table: ids are
    not broadcast, and edges are not sorted, which would take the memory of a task.
    """
    gone = removed.select("id").hint("shuffle_hash")
    nodes = graph.nodes.join(gone, "id", "left_anti")
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return graph.with_nodes(nodes).with_edges(edges.select(*graph.edges.columns))


def drop_sysroot(graph: Graph) -> Graph:
    return without(graph, graph.nodes.filter(is_sysroot(F.col("path"))))


def apply_scope(graph: Graph, scope: str) -> Graph:
    """scope: "full" keeps the graph, "own_code" drops sysroot nodes."""
    if scope not in ("full", "own_code"):
        raise GraphError(f"unknown scope: {scope}")
    return drop_sysroot(graph) if scope == "own_code" else graph


def keep_members(graph: Graph, members: DataFrame) -> Graph:
    """Keep nodes whose crate is one of members(name); dashes and underscores are the same."""
    names = members.select(F.translate("name", "-", "_").alias("member")).distinct()
    outside = graph.nodes.withColumn("member", member_name(F.col("path"))).join(names, "member", "left_anti")
    return without(graph, outside)


def reference_only(graph: Graph) -> Graph:
    """Keep owns edges, and uses edges by reference; uses edges without a kind go."""
    return graph.with_edges(graph.edges.filter("relation = 'owns' or uses_kind <=> 'reference'"))


def uses_kind_census(graph: Graph) -> DataFrame:
    """One row: uses edges, and how many of them have a kind, are references, are imports."""
    uses = F.col("relation") == "uses"
    count = lambda c, name: F.count_if(c).alias(name)
    return graph.edges.agg(count(uses, "n_uses"), count(uses & F.col("uses_kind").isNotNull(), "n_typed"), count(uses & (F.col("uses_kind") == "reference"), "n_reference"), count(uses & (F.col("uses_kind") == "import"), "n_import"))


def apply_uses_mode(graph: Graph, mode: str) -> Graph:
    """mode: "all", or "reference_only", which refuses a graph whose uses edges have no kinds at all."""
    if mode not in ("all", "reference_only"):
        raise GraphError(f"unknown uses mode: {mode}")
    if mode == "all":
        return graph
    census = uses_kind_census(graph).first()
    if census["n_uses"] and not census["n_typed"]:
        raise UntypedUses("the graph's uses edges carry no kind")
    return reference_only(graph)
