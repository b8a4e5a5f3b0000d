"""From items to modules: containment, the quotient graph, coupling weights, exact module radii."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.graph import Graph
from undertow.operators.degrees import owns_parents
from undertow.operators.numbering import numbered
from undertow.operators.ranking import ONE_MASK, node_edges, part_edges, reaching
from undertow.operators.scc import components
from undertow.runtime import materialize, materialize_counted, shuffled
from undertow.schema import MODULE_KINDS


def containing_modules(graph: Graph) -> DataFrame:
    """(id, module): the nearest module or crate above each node; modules contain themselves.

    Climbs by pointer doubling. Nodes without a module above them, and those whose owners form a
    ring, are absent.
    """
    is_module = F.col("kind").isin(*MODULE_KINDS)
    modules = graph.nodes.filter(is_module).select("id")
    items = graph.nodes.filter(~is_module).select("id")
    parents = owns_parents(graph).join(shuffled(items), "id", "left_semi")
    flagged = parents.join(shuffled(modules.select(F.col("id").alias("parent"), F.lit(True).alias("done"))), "parent", "left")
    flagged = flagged.select("id", F.col("parent").alias("above"), F.coalesce("done", F.lit(False)).alias("done"))
    climb, now = materialize_counted(flagged, "climb", open=F.count_if(~F.col("done")))
    left = -1
    while now["open"] not in (0, left):
        left = now["open"]
        up = climb.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("done").alias("next_done"))
        moved = climb.filter("not done").join(shuffled(up), "above").select("id", F.col("next").alias("above"), F.col("next_done").alias("done"))
        climb, now = materialize_counted(climb.filter("done").unionByName(moved), "climb", open=F.count_if(~F.col("done")))
    inside = climb.filter("done").select("id", F.col("above").alias("module"))
    return inside.unionByName(modules.select("id", F.col("id").alias("module")))


def _between_modules(graph: Graph, contained: DataFrame) -> DataFrame:
    """(src_module, dst_module) of each uses edge that leaves its module."""
    side = lambda end: shuffled(contained.select(F.col("id").alias(end), F.col("module").alias(f"{end}_module")))
    joined = graph.uses().select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")
    return joined.filter("src_module != dst_module").select("src_module", "dst_module")


def coupling_weights(graph: Graph, contained: DataFrame) -> DataFrame:
    """(src_module, dst_module, weight): item-level uses edges between two modules."""
    return _between_modules(graph, contained).groupBy("src_module", "dst_module").agg(F.count("*").alias("weight"))


def module_graph(graph: Graph, contained: DataFrame, weights: DataFrame | None = None) -> Graph:
    """The quotient graph: modules, distinct uses between them (without a kind) and distinct owns.

    weights: what coupling_weights gave, if it is there already; it names each pair once.
    """
    nodes = graph.nodes.filter(F.col("kind").isin(*MODULE_KINDS))
    pairs = weights if weights is not None else _between_modules(graph, contained).distinct()
    uses = pairs.select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"), F.lit("uses").alias("relation"))
    ids = nodes.select("id")
    owns = graph.owns().join(shuffled(ids.withColumnRenamed("id", "src")), "src", "left_semi").join(shuffled(ids.withColumnRenamed("id", "dst")), "dst", "left_semi")
    owns = owns.groupBy("src", "dst", "relation").agg(F.min("edge_seq").alias("edge_seq"))
    return Graph.of(nodes, owns.unionByName(uses, allowMissingColumns=True).fillna(0, ["edge_seq"]), graph.name)


def module_radii(graph: Graph, contained: DataFrame) -> DataFrame:
    """(module, direction, other): modules reached from a module's items, by paths of items.

    Exact: the search runs on items and is projected, since a path in the quotient graph need not
    be one of items. The module itself is never listed. Modules are numbered and 64 of them share a
    mask, which travels along the condensation of the items; masks are united by the module of
    the items that they reach before anything is listed. A module reaches another upstream if
    that one reaches it downstream, so there is one search. If all modules share one mask, it
    travels along the items themselves, and their components are not asked for.
    """
    numbers, n = materialize_counted(numbered(contained.select("module").distinct(), ["module"], "number"), "modules", n=F.count("*"))
    one = n["n"] <= ONE_MASK
    parts = graph.nodes.select("id", F.col("id").alias("part")) if one else materialize(components(graph).select("id", F.col("scc").alias("part")), "parts")
    placed = contained.join(shuffled(parts), "id").join(shuffled(numbers), "module").select("module", "number", "part").distinct()
    placed = materialize(placed, "placed")
    masks = reaching(node_edges(graph) if one else part_edges(graph, parts), placed.select(F.col("number").alias("id"), "part"), dealt=one)
    seen = masks.join(shuffled(placed.select("module", "part")), "part").groupBy("module", "block").agg(F.bit_or("mask").alias("mask"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("mask", k) == 1)
    pairs = seen.select(F.col("module").alias("low"), "block", F.explode(bits).alias("bit")).withColumn("number", F.col("block") * 64 + F.col("bit"))
    pairs = materialize(pairs.join(shuffled(numbers.select("number", F.col("module").alias("high"))), "number").filter("low != high").select("low", "high"), "radii")
    # "high" reaches "low" along the edges: low is downstream of it.
    down = pairs.select(F.col("high").alias("module"), F.lit("downstream").alias("direction"), F.col("low").alias("other"))
    return down.unionByName(pairs.select(F.col("low").alias("module"), F.lit("upstream").alias("direction"), F.col("high").alias("other")))
