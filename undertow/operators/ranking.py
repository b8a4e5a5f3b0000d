"""Ranking of all nodes by how many others depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.graph import Graph
from undertow.operators.degrees import classification
from undertow.operators.scc import components
from undertow.operators.numbering import numbered
from undertow.runtime import materialize, materialize_counted, shuffled, stored_by

_HOPS = 3
#: Up to so many starts take one mask at each node, so a search needs no condensation to keep its rows few.
ONE_MASK = 64


def reaching(edges: DataFrame, members: DataFrame, *, dealt: bool = False) -> DataFrame:
    """(part, block, mask): which nodes reach each part of a graph, or belong to it; 64 node ids to a mask.

    edges: (src, dst) between parts; members: (id, part). Node id is bit id % 64 of block id / 64,
    so up to 64 pairs take one row. Each round sends the bits that were new in the last one along
    the edges for _HOPS hops. Cycles end the search like any other way that brings nothing new.
    dealt: edges are stored by src and members have one block, so hops have fewer rows than nodes: those
    travel and are hashed, and the edges stay where they are, unsorted.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(64)).cast("int"))
    own = members.select("part", F.floor(F.col("id") / 64).alias("block"), bit.alias("mask"))
    known, n = materialize_counted(own.groupBy("part", "block").agg(F.bit_or("mask").alias("mask")), "masks", new=F.count("*"))
    fresh = known
    while n["new"]:
        sent, hop = None, fresh
        for _ in range(_HOPS):
            at = hop.withColumnRenamed("part", "src")
            met = edges.join(at.hint("shuffle_hash"), "src") if dealt else at.join(shuffled(edges), "src")
            hop = met.groupBy(F.col("dst").alias("part"), "block").agg(F.bit_or("mask").alias("mask"))
            sent = hop if sent is None else sent.unionByName(hop)
        sent = sent.groupBy("part", "block").agg(F.bit_or("mask").alias("mask"))
        new = sent.join(shuffled(known.withColumnRenamed("mask", "had")), ["part", "block"], "left")
        new = new.select("part", "block", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("mask"))
        fresh, n = materialize_counted(new.filter("mask != 0"), "fresh", new=F.count("*"))
        known = materialize(known.unionByName(fresh).groupBy("part", "block").agg(F.bit_or("mask").alias("mask")), "masks")
    return known


def part_edges(graph: Graph, parts: DataFrame) -> DataFrame:
    """(src, dst): distinct uses edges between different parts. parts: (id, part)."""
    side = lambda end: shuffled(parts.select(F.col("id").alias(end), F.col("part").alias(f"{end}_part")))
    edges = graph.uses().select("src", "dst").join(side("src"), "src").join(side("dst"), "dst").filter("src_part != dst_part")
    return materialize(edges.select(F.col("src_part").alias("src"), F.col("dst_part").alias("dst")).distinct(), "between")


def node_edges(graph: Graph) -> DataFrame:
    """(src, dst): distinct uses edges between different nodes, stored by src, for a search in which each node is a part."""
    return stored_by(graph.uses().filter("src != dst").select("src", "dst"), "src", "between")


def impacts(graph: Graph, parts: DataFrame | None = None) -> DataFrame:
    """(id, path, impact): number of nodes that depend on each node, directly or not, without itself.

    Members of a component are reached by the same nodes, so the search runs on components.
    """
    parts = materialize(components(graph) if parts is None else parts, "parts")
    placed = parts.select("id", F.col("scc").alias("part"))
    masks = reaching(part_edges(graph, placed), placed)
    total = masks.groupBy(F.col("part").alias("scc")).agg((F.sum(F.bit_count("mask")) - 1).alias("impact"))
    return parts.join(shuffled(total), "scc").select("id", "path", "impact")


def reach_sizes(graph: Graph, targets: DataFrame) -> DataFrame:
    """(target, direction, n): how many nodes each of targets(id) reaches upstream and downstream, itself left out.

    Targets of one component reach the same nodes, so the components that hold targets are numbered, not the targets;
    64 of them share a mask that travels along the condensation, forth and back. Each part then adds its
    number of nodes to the bits of its masks, so no pair is ever listed. If all targets share one mask, it travels
    along the graph itself, and each node is a part. An id that several rows share is one node.
    """
    wanted, n = materialize_counted(targets.select("id").distinct(), "targets", n=F.count("*"))
    one = n["n"] <= ONE_MASK
    placed = graph.nodes.select("id").distinct().withColumn("part", F.col("id")) if one else materialize(components(graph).select("id", F.col("scc").alias("part")).distinct(), "parts")
    nodes = placed.groupBy("part").agg(F.count("*").alias("nodes"))
    wanted = materialize(placed.join(shuffled(wanted), "id"), "wanted")
    numbers = materialize(numbered(wanted.select("part").distinct(), ["part"], "number"), "numbers")
    starts = numbers.select("part", F.col("number").alias("id"))
    edges = node_edges(graph) if one else part_edges(graph, placed)
    sizes = []
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    for direction, ways in (("downstream", edges), ("upstream", stored_by(turned, "src", "between") if one else turned)):
        masks = reaching(ways, starts, dealt=one).join(shuffled(nodes), "part")
        summed = masks.groupBy("block").agg(F.array(*[F.sum(F.getbit("mask", F.lit(k)) * F.col("nodes")) for k in range(64)]).alias("sums"))
        each = summed.select("block", F.posexplode("sums").alias("bit", "n")).select((F.col("block") * 64 + F.col("bit")).alias("number"), (F.col("n") - 1).alias("n"))
        sizes.append(numbers.join(shuffled(each), "number").select("part", F.lit(direction).alias("direction"), "n"))
    return wanted.join(shuffled(sizes[0].unionByName(sizes[1])), "part").select(F.col("id").alias("target"), "direction", "n")


def rank_nodes(graph: Graph, top: int = 10) -> DataFrame:
    """(position, path, impact, class) of the first `top` nodes by impact, ties by path; zero impacts count."""
    ranked = impacts(graph).join(shuffled(classification(graph).select("id", "class")), "id")
    first = ranked.orderBy(F.desc("impact"), "path", "id").limit(top)  # a bounded top-k, not a global sort
    position = F.row_number().over(W.orderBy(F.desc("impact"), "path", "id")).cast("long")
    return first.select(position.alias("position"), "path", "impact", "class")
