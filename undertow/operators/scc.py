"""Strongly connected components of the uses edges, cycles, and the condensation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.graph import Graph
from undertow.operators.reach import reach
from undertow.runtime import materialize, materialize_counted, shuffled

_HOPS = 3


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose both ends have edges in and out; others close no cycle. One round."""
    both = edges.select(F.col("src").alias("v")).distinct().join(shuffled(edges.select(F.col("dst").alias("v")).distinct()), "v", "left_semi")
    edges = edges.join(shuffled(both.withColumnRenamed("v", "src")), "src", "left_semi")
    return edges.join(shuffled(both.withColumnRenamed("v", "dst")), "dst", "left_semi").select("src", "dst")


def _trim(edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Rounds of trimming while they take a tenth of the n edges; what is left, and how many, coloring settles."""
    before, now = 0, n
    while now and (not before or now < 0.9 * before):
        edges, left = materialize_counted(_trimmed(edges), "trimmed", n=F.count("*"))
        before, now = now, left["n"]
    return edges, now


def _lowest_reaching(edges: DataFrame, turn: int) -> DataFrame:
    """(v, color): the first node, in the order of this turn, from which v can be reached, itself included.

    The first turn orders nodes by id, the others by chance, so that no order of the ids makes
    many turns necessary.
    """
    rank = lambda c: F.struct((F.lit(0).cast("long") if turn == 0 else F.xxhash64(F.col(c), F.lit(turn))).alias("r"), F.col(c).alias("id"))
    nodes = edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct()
    colors, n = materialize_counted(nodes.select("v", rank("v").alias("color"), F.lit(True).alias("moved")), "colors", moved=F.count("*"))
    while n["moved"]:
        new, sent = colors.select("v", F.col("color").alias("was")), colors.filter("moved").select("v", "color")
        arrived = None
        for _ in range(_HOPS):
            sent = shuffled(edges).join(sent.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("color").alias("color"))
            arrived = sent if arrived is None else arrived.unionByName(sent)
        new = new.join(shuffled(arrived.groupBy("v").agg(F.min("color").alias("low"))), "v", "left")
        new = new.select("v", F.least("was", "low").alias("color"), F.coalesce(F.col("low") < F.col("was"), F.lit(False)).alias("moved"))
        colors, n = materialize_counted(new, "colors", moved=F.count_if("moved"))
    return colors.select("v", "color.id").withColumnRenamed("id", "color")


def _within_colors(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """Edges between nodes of one color: the nodes of a component are reached by the same nodes, so no other edge lies within one."""
    inner = edges.join(shuffled(colors.select(F.col("v").alias("src"), F.col("color"))), "src").join(shuffled(colors.select(F.col("v").alias("dst"), F.col("color").alias("c2"))), "dst")
    return inner.filter("color = c2").select("src", "dst")


def _back_to_root(inner: DataFrame, colors: DataFrame) -> DataFrame:
    """(v, color) of the nodes that reach their color's root through nodes of that color."""
    roots = colors.filter("v = color")
    back = reach(inner, roots.select(F.col("color").alias("target"), F.col("v").alias("node")), "upstream")
    return roots.unionByName(back.select(F.col("node").alias("v"), F.col("target").alias("color")))


def components(graph: Graph) -> DataFrame:
    """(id, scc, label): every node's component, known by its smallest id and by its smallest path.

    Nodes without edges in and out are trimmed away while that pays. Then each node takes the first node that
    reaches it as its color; the nodes of a color that reach the color's own node are one
    component. They leave, and so do the edges between colors, which lie within no component: what is
    left falls apart into ever smaller pieces that are colored again all at once. The smallest id
    names a component.
    """
    first, n = materialize_counted(graph.uses().filter("src != dst").select("src", "dst").distinct(), "uses", n=F.count("*"))
    rest, left = _trim(first, n["n"])
    found: list[DataFrame] = []
    while left:
        colors = _lowest_reaching(rest, len(found))
        rest = materialize(_within_colors(rest, colors), "inner")
        members = materialize(_back_to_root(rest, colors), "members")
        found.append(members)
        for end in ("src", "dst"):
            rest = rest.join(shuffled(members.select(F.col("v").alias(end))), end, "left_anti")
        rest, n = materialize_counted(rest.select("src", "dst"), "rest", n=F.count("*"))
        rest, left = _trim(rest, n["n"])
    nodes = graph.nodes.select("id", "path")
    if found:
        every = reduce(DataFrame.unionByName, found)
        nodes = nodes.join(shuffled(every.withColumnRenamed("v", "id")), "id", "left")
    else:
        nodes = nodes.withColumn("color", F.lit(None).cast("long"))
    nodes = nodes.withColumn("color", F.coalesce("color", "id"))
    labels = nodes.groupBy("color").agg(F.min("id").alias("scc"), F.min("path").alias("label"))
    return nodes.join(shuffled(labels), "color").select("id", "path", "scc", "label")


def cycles(parts: DataFrame) -> DataFrame:
    """(label, size, members): components of two or more nodes, members sorted. A self-loop is no cycle."""
    grouped = parts.groupBy("label").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("path")).alias("members"))
    return grouped.filter("size >= 2")


def cycle_summary(parts: DataFrame) -> DataFrame:
    """One row: number of cycles and size of the largest, 0 without any."""
    sizes = parts.groupBy("label").agg(F.count("*").alias("size")).filter("size >= 2")
    return sizes.agg(F.count("*").alias("n_cycles"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))


def condensation(graph: Graph, parts: DataFrame) -> DataFrame:
    """(src, dst): distinct uses edges between different components, by label."""
    side = lambda end: parts.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    joined = graph.uses().select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")
    return joined.filter("src_label != dst_label").select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).distinct()
