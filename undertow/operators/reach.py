"""Breadth-first reach from many targets at once, and what is built on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.graph import Graph
from undertow.operators.degrees import classification, owns_children, owns_parents
from undertow.runtime import materialize, materialize_counted, shuffled
from undertow.schema import TargetNotFound

_HOPS, _PARTS = 3, 6
#: A frontier of at most _FEW rows, which were counted, goes to all tasks, one hop to a job, where a shuffle would move _MANY edges or more.
_FEW, _MANY = 20_000, 1_000_000


def reach(edges: DataFrame, targets: DataFrame, direction: str) -> DataFrame:
    """(target, node, depth): shortest uses-distance from each target, the target itself left out.

    edges: (src, dst); targets: (target, node), the start nodes of each target. direction:
    "upstream" (who depends on it) or "downstream" (what it depends on). Semi-naive: each round
    goes _HOPS hops from the last frontier, drops what was seen before and writes the rest to the
    shared folder; what was seen is one table again after every _PARTS rounds. Where a small frontier
    meets many edges, the frontier travels and the edges stay where they are.
    """
    if direction not in ("upstream", "downstream"):
        raise ValueError(f"unknown direction: {direction}")
    return _reach(*_stored_pairs(edges), targets, direction)


def _stored_pairs(edges: DataFrame) -> tuple[DataFrame, int]:
    """(the distinct pairs of edges, how many)."""
    pairs, n = materialize_counted(edges.select("src", "dst").distinct(), "steps", n=F.count("*"))
    return pairs, n["n"]


def _reach(pairs: DataFrame, size: int, targets: DataFrame, direction: str) -> DataFrame:
    near, far = ("dst", "src") if direction == "upstream" else ("src", "dst")
    steps = pairs.select(F.col(near).alias("node"), F.col(far).alias("next"))
    key = ["target", "node"]
    frontier, n = materialize_counted(targets.select(*key).distinct().withColumn("depth", F.lit(0).cast("long")), "frontier", left=F.count("*"))
    parts, deep = [frontier], 0
    while n["left"]:
        hops, hop = [], frontier.select(*key)
        few = n["left"] <= _FEW and size >= _MANY
        span = 1 if few else _HOPS
        for k in range(1, span + 1):
            met = steps.join(F.broadcast(hop), "node") if few else hop.join(shuffled(steps), "node")
            hop = met.select("target", F.col("next").alias("node")).distinct()
            hops.append(hop.withColumn("depth", F.lit(deep + k).cast("long")))
        # A node at distance deep + k is k hops from some node of the frontier, and nearer to none.
        grown = reduce(DataFrame.unionByName, hops).groupBy(*key).agg(F.min("depth").alias("depth"))
        fresh = grown.join(shuffled(reduce(DataFrame.unionByName, parts)), key, "left_anti")
        fresh, n = materialize_counted(fresh, "reached", left=F.count_if(F.col("depth") == deep + span))
        deep += span
        frontier = fresh.filter(F.col("depth") == deep)
        parts.append(fresh)
        if len(parts) > _PARTS:
            parts = [materialize(reduce(DataFrame.unionByName, parts), "reached")]
    return reduce(DataFrame.unionByName, parts).filter("depth > 0")


def impact_reach(graph: Graph, targets: DataFrame) -> DataFrame:
    """(target, direction, node, depth) in both directions for each target(id)."""
    starts = targets.select(F.col("id").alias("target"), F.col("id").alias("node"))
    pairs = _stored_pairs(graph.uses())
    both = [_reach(*pairs, starts, d).withColumn("direction", F.lit(d)) for d in ("upstream", "downstream")]
    return both[0].unionByName(both[1]).select("target", "direction", "node", "depth")


def radius(graph: Graph, *, path: str | None = None, node_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row about the target, its reach with paths). Exactly one of path and node_id is given."""
    if (path is None) == (node_id is None):
        raise ValueError("give a path or an id")
    wanted = graph.nodes.filter(F.col("path") == path) if path is not None else graph.nodes.filter(F.col("id") == node_id)
    first = wanted.select("id").first()
    if first is None:
        raise TargetNotFound(str(path if path is not None else node_id))
    target = wanted.filter(F.col("id") == first["id"]).select("id").limit(1)
    names = graph.nodes.select("id", "path")
    found = impact_reach(graph, target).join(names.select(F.col("id").alias("node"), "path"), "node")
    # What is said about the target itself needs the edges at it only.
    at = Graph(graph.nodes, graph.edges.filter((F.col("src") == first["id"]) | (F.col("dst") == first["id"])))
    own = at.with_nodes(graph.nodes.filter(F.col("id") == first["id"]))
    parent = names.select(F.col("id").alias("parent"), F.col("path").alias("owns_parent")).join(F.broadcast(owns_parents(at).filter(F.col("id") == first["id"])), "parent")  # one row
    about = classification(own).join(parent.select("id", "owns_parent"), "id", "left").join(owns_children(at), "id", "left")
    return about, materialize(found.select("direction", "path", "depth"), "radius")


def max_depths(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, max_upstream, max_downstream), 0 where nothing is reached."""
    deep = lambda d: F.coalesce(F.max(F.when(F.col("direction") == d, F.col("depth"))), F.lit(0)).alias(f"max_{d}")
    return targets.select(F.col("id").alias("target")).join(found, "target", "left").groupBy("target").agg(deep("upstream"), deep("downstream"))


def combined(found: DataFrame) -> DataFrame:
    """(direction, node, depth): smallest depth over all targets of a reach that is there already."""
    return found.groupBy("direction", "node").agg(F.min("depth").alias("depth"))


def combined_reach(edges: DataFrame, starts: DataFrame, direction: str) -> DataFrame:
    """(node, depth): distance of each node from the nearest other one of starts(id), in one search for all of them.

    Each node keeps its two nearest starts only: a start has itself at distance 0 and needs the next
    one. Two are enough for everything behind a node, too. So there are at most two rows for a
    node, where a search by target has one for each pair.
    """
    if direction not in ("upstream", "downstream"):
        raise ValueError(f"unknown direction: {direction}")
    near, far = ("dst", "src") if direction == "upstream" else ("src", "dst")
    steps = materialize(edges.select(F.col(near).alias("node"), F.col(far).alias("next")).distinct(), "steps")
    frontier = starts.select(F.col("id").alias("node"), F.col("id").alias("start")).distinct().withColumn("depth", F.lit(0).cast("long"))
    frontier, n = materialize_counted(frontier, "frontier", left=F.count("*"))
    parts, deep = [frontier], 0
    two = lambda: F.array_distinct(F.array(F.min("start"), F.max("start")))
    while n["left"]:
        hops, hop = [], frontier.select("node", "start")
        for k in range(1, _HOPS + 1):
            # Of more than two starts that come from the same distance, any two will do.
            met = hop.join(shuffled(steps), "node").groupBy(F.col("next").alias("node")).agg(two().alias("two"))
            hop = met.select("node", F.explode("two").alias("start"))
            hops.append(hop.withColumn("depth", F.lit(deep + k).cast("long")))
        known = reduce(DataFrame.unionByName, parts)
        grown = reduce(DataFrame.unionByName, hops).groupBy("node", "start").agg(F.min("depth").alias("depth"))
        order = W.partitionBy("node").orderBy("depth", "start")
        every = known.withColumn("new", F.lit(False)).unionByName(grown.join(shuffled(known), ["node", "start"], "left_anti").withColumn("new", F.lit(True)))
        kept = every.withColumn("place", F.row_number().over(order)).filter("place <= 2 and new")
        fresh, n = materialize_counted(kept.select("node", "start", "depth"), "reached", left=F.count_if(F.col("depth") == deep + _HOPS))
        deep += _HOPS
        frontier = fresh.filter(F.col("depth") == deep)
        parts = [materialize(reduce(DataFrame.unionByName, [*parts, fresh]), "reached")] if len(parts) > _PARTS else [*parts, fresh]
    return reduce(DataFrame.unionByName, parts).filter("node != start").groupBy("node").agg(F.min("depth").alias("depth"))


def combined_radius(graph: Graph, targets: DataFrame) -> DataFrame:
    """(direction, node, depth) from the nearest other of targets(id), in both directions."""
    ways = [combined_reach(graph.uses(), targets, d).select(F.lit(d).alias("direction"), "node", "depth") for d in ("upstream", "downstream")]
    return ways[0].unionByName(ways[1])
