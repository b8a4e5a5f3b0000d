"""Path collisions: nodes that share a path are told apart or merged, all paths at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.functions import insert_trait
from undertow.graph import Graph
from undertow.runtime import materialize
from undertow.schema import Undecided


def collisions(graph: Graph) -> DataFrame:
    """(path, copies) of the paths with more than one node."""
    return graph.nodes.groupBy("path").agg(F.count("*").alias("copies")).filter("copies > 1")


def verdicts(graph: Graph) -> DataFrame:
    """(path, a, b, copies, shared, only_a, only_b, verdict) of each collision.

    The two copies with the smallest ids speak for all. An edge is shared if it joins them; one
    that touches just one of them is its own. Distinct: both have edges of their own and none is
    shared. Same item: only shared ones. Anything else is undecided.
    """
    ranked = graph.nodes.join(collisions(graph), "path").withColumn("place", F.row_number().over(W.partitionBy("path").orderBy("id"))).filter("place <= 2")
    pairs = ranked.groupBy("path", "copies").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    ends = pairs.select("path", F.explode(F.array("a", "b")).alias("end"))
    edges = graph.edges.select("src", "dst", "relation").distinct()
    touching = edges.join(ends.withColumnRenamed("end", "src"), "src").select("path", "src", "dst", "relation")
    touching = touching.union(edges.join(ends.withColumnRenamed("end", "dst"), "dst").select("path", "src", "dst", "relation")).distinct()
    count = lambda c, name: F.coalesce(F.count_if(c), F.lit(0)).alias(name)
    joins = (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")) | (F.col("src") == F.col("b")) & (F.col("dst") == F.col("a"))
    at = lambda end: (F.col("src") == F.col(end)) | (F.col("dst") == F.col(end))
    seen = pairs.join(touching, "path", "left").groupBy("path", "a", "b", "copies").agg(count(joins, "shared"), count(~joins & at("a"), "only_a"), count(~joins & at("b"), "only_b"))
    distinct = (F.col("shared") == 0) & (F.col("only_a") > 0) & (F.col("only_b") > 0)
    same = (F.col("shared") > 0) & (F.col("only_a") == 0) & (F.col("only_b") == 0)
    return seen.withColumn("verdict", F.when(distinct, "distinct").when(same, "same_item").otherwise("undecided"))


def ladder_names(graph: Graph, judged: DataFrame) -> DataFrame:
    """(id, path, new_path) of the copies of distinct items.

    The trait goes into the path; if copies still agree, the full trait reference instead; and
    copies without either, or that agree even so, get # and their place among all copies by id.
    """
    copies = graph.nodes.select("id", "path", "trait", "trait_ref").join(judged.filter("verdict = 'distinct'").select("path"), "path")
    copies = copies.withColumn("place", F.row_number().over(W.partitionBy("path").orderBy("id")))
    agree = lambda *cols: F.count("*").over(W.partitionBy("path", *cols)) > 1
    copies = copies.withColumn("alone", F.col("trait").isNotNull() & ~agree("trait"))
    copies = copies.withColumn("second", ~F.col("alone") & F.col("trait").isNotNull() & F.col("trait_ref").isNotNull())
    copies = copies.withColumn("second", F.col("second") & ~agree("second", "trait", "trait_ref"))
    name = F.when(F.col("alone"), insert_trait(F.col("path"), F.col("trait"))).when(F.col("second"), insert_trait(F.col("path"), F.col("trait_ref")))
    return copies.select("id", "path", F.coalesce(name, F.concat("path", F.lit("#"), F.col("place").cast("string"))).alias("new_path"))


def rename_distinct(graph: Graph, names: DataFrame) -> Graph:
    nodes = graph.nodes.join(names.select("id", "new_path"), "id", "left")
    return graph.with_nodes(nodes.withColumn("path", F.coalesce("new_path", "path")).select(*graph.nodes.columns))


def merge_same(graph: Graph, judged: DataFrame) -> Graph:
    """Copies of one item become the copy with the smallest id; its edges move there.

    Where anything was merged, edges of the whole graph that agree in ends and relation become one,
    the first in order; their uses kinds may differ.
    """
    same = judged.filter("verdict = 'same_item'").select("path", F.col("a").alias("kept"))
    moved = graph.nodes.select("id", "path").join(same, "path").filter("id != kept").select("id", "kept")
    if moved.isEmpty():
        return graph
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(moved.select(F.col("id").alias(end), "kept"), end, "left").withColumn(end, F.coalesce("kept", end)).drop("kept")
    rest = [c for c in graph.edges.columns if c not in ("src", "dst", "relation")]
    first = edges.groupBy("src", "dst", "relation").agg(F.min(F.struct("edge_seq", *[c for c in rest if c != "edge_seq"])).alias("first"))
    edges = first.select("src", "dst", "relation", *[F.col(f"first.{c}").alias(c) for c in rest]).select(*graph.edges.columns)
    return graph.with_nodes(graph.nodes.join(moved.select("id"), "id", "left_anti").select(*graph.nodes.columns)).with_edges(edges)


def resolve(graph: Graph, *, skip_undecided: bool = False) -> Graph:
    """A graph whose paths are unique; a collision without a verdict is an error unless skipped.

    Renaming touches only paths and verdicts use ids, and merging changes no other verdict, so all
    collisions are settled in one step.
    """
    judged = materialize(verdicts(graph), "verdicts")
    if not skip_undecided:
        open_ones = [r["path"] for r in judged.filter("verdict = 'undecided'").select("path").orderBy("path").limit(5).collect()]
        if open_ones:
            raise Undecided(", ".join(open_ones))
    return merge_same(rename_distinct(graph, ladder_names(graph, judged)), judged)
