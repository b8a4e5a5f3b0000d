"""What a set of changed line ranges touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.functions import crate_of, path_ends, ranges_overlap, short_name
from undertow.graph import Graph
from undertow.operators.reach import impact_reach
from undertow.runtime import shuffled


#: Levels of bins, each 16 times as wide as the one below: the widest hold 2^32 lines.
_LEVELS = range(9)


def _files_meeting(own: DataFrame, changed: DataFrame) -> DataFrame:
    """(own, file): files of the graph and the changed files that they are, or end in after a "/".

    Every file of the graph is cut into its ends, which meet the changed files by equality: no key
    is shared by files that only have a base name in common.
    """
    ends = own.select("own").distinct().select("own", F.explode(path_ends(F.col("own"))).alias("file"))
    return ends.join(shuffled(changed.select("file").distinct()), "file")


def _own_bin(a: Column, b: Column) -> Column:
    """The narrowest bin that holds all lines from a to b (in either order), as (level, bin)."""
    at = lambda k: F.struct(F.lit(k).alias("level"), F.shiftright(a, 4 * k).alias("bin"))
    return F.coalesce(*[F.when(F.shiftright(a, 4 * k) == F.shiftright(b, 4 * k), at(k)) for k in _LEVELS[:-1]], at(_LEVELS[-1]))


def _wider_bins(own: Column, first: int) -> Column:
    """The bins that hold an own bin, `first` levels above it and wider; from 0, itself included."""
    up = lambda k: F.struct(k.alias("level"), F.call_function("shiftright", own["bin"], 4 * (k - own["level"])).alias("bin"))
    levels = F.filter(F.array(*map(F.lit, _LEVELS)), lambda k: k >= own["level"] + first)
    return F.transform(levels, up)


def touched_nodes(graph: Graph, ranges: DataFrame) -> DataFrame:
    """(id, path) of nodes whose lines meet a changed range. ranges: (file, start, end).

    A node's file must be the changed one or end in it after a "/". Lines meet where the narrowest
    bin of one range is that of the other, or lies above or below it in the tree of bins; so nodes
    and ranges meet by equality of file and bin, and only then are their lines compared.
    """
    long = lambda c: F.col(c).cast("long")
    placed = graph.nodes.filter("position is not null").select("id", "path", F.col("position.file").alias("own"), long("position.start_line").alias("a"), long("position.end_line").alias("b"))
    placed = placed.withColumn("narrow", _own_bin(F.col("a"), F.col("b")))
    changed = ranges.select("file", long("start").alias("start"), long("end").alias("end")).distinct()
    files = _files_meeting(placed, changed)
    changed = files.join(shuffled(changed), "file").select("own", "start", "end").distinct().withColumn("narrow", _own_bin(F.col("start"), F.col("end")))
    lines = ranges_overlap(F.col("a"), F.col("b"), F.col("start"), F.col("end"))

    def met(nodes: Column, others: Column) -> DataFrame:
        left = placed.select("id", "path", "own", "a", "b", F.explode(nodes).alias("at")).alias("l")
        right = changed.select("own", "start", "end", F.explode(others).alias("at")).alias("r")
        return left.join(shuffled(right), (F.col("l.own") == F.col("r.own")) & (F.col("l.at.level") == F.col("r.at.level")) & (F.col("l.at.bin") == F.col("r.at.bin")) & lines, "left_semi").select("id", "path")

    narrow = F.col("narrow")
    below = met(_wider_bins(narrow, 0), F.array(narrow))
    above = met(F.array(narrow), _wider_bins(narrow, 1))
    return below.unionByName(above).distinct()


def untracked_census(graph: Graph, files: DataFrame, member_dirs: DataFrame) -> DataFrame:
    """(file, bucket) of untracked files: linked (in the graph), loose (source under a member), else non_source.

    files: (file, origin); member_dirs: (dir), relative to the same root as the files, "" for the root.
    """
    new = files.filter("origin = 'untracked'").select("file").distinct()
    known = graph.nodes.filter("position is not null").select(F.col("position.file").alias("own"))
    linked = _files_meeting(known, new).select("file").distinct().withColumn("linked", F.lit(True))
    # Every folder above a file, from the root down, meets the members by equality.
    parts = F.split("file", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = new.select("file", F.explode(folders).alias("dir")).join(member_dirs.select("dir").distinct(), "dir", "left_semi").select("file").distinct().withColumn("inside", F.lit(True))
    rows = new.join(linked, "file", "left").join(inside, "file", "left")
    source = F.col("file").rlike(r"[^/]\.rs$") & F.coalesce("inside", F.lit(False))
    return rows.select("file", F.when(F.col("linked"), "linked").when(source, "loose").otherwise("non_source").alias("bucket"))


def touched_radius(graph: Graph, touched: DataFrame) -> DataFrame:
    """(target, direction, node, depth): one search for all touched nodes together."""
    return impact_reach(graph, touched.select("id"))


def by_crate(paths: DataFrame) -> DataFrame:
    """(crate, n), largest first and then by name."""
    return paths.groupBy(crate_of(F.col("path")).alias("crate")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "crate")


def touched_by_crate(touched: DataFrame) -> DataFrame:
    """(crate, name): each touched path within its crate, once."""
    return touched.select(crate_of(F.col("path")).alias("crate"), short_name(F.col("path"), crate_of(F.col("path"))).alias("name")).distinct()
