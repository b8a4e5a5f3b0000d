"""The analyses that a user asks for: radius, ranking, structure, diff, workspace, comparison."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.graph import Graph
from undertow.operators import compare, diffing, modules, ranking, reach, resolve, scc, workspace
from undertow.operators.dsm import dsm_order
from undertow.operators.filters import apply_scope, apply_uses_mode, keep_members
from undertow.runtime import materialize, shuffled
from undertow.schema import MODULE_KINDS, GraphError, Undecided


def prepare(graph: Graph, scope: str = "full") -> Graph:
    """A graph with unique paths, in scope."""
    return apply_scope(resolve.resolve(graph), scope).stored()


def analyse_radius(graph: Graph, *, path: str | None = None, node_id: int | None = None, scope: str = "full") -> tuple[DataFrame, DataFrame]:
    return reach.radius(prepare(graph, scope), path=path, node_id=node_id)


def analyse_ranking(graph: Graph, *, top: int = 10, scope: str = "full") -> DataFrame:
    return ranking.rank_nodes(prepare(graph, scope), top)


@dataclass(frozen=True)
class Structure:
    modules: DataFrame  # (id, path)
    dependencies: DataFrame  # (src, dst, weight) by path
    cycles: DataFrame
    order: DataFrame
    find_radii: Callable[[], DataFrame]

    @cached_property
    def radii(self) -> DataFrame:
        """(module, direction, other) by path. A search over all items, made only if somebody reads it."""
        return self.find_radii()


def _dependencies(graph: Graph, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modules by id and path, dependencies with weight by path)."""
    names = graph.nodes.filter(F.col("kind").isin(*MODULE_KINDS)).select("id", "path")
    named = lambda df, c, to: df.join(shuffled(names.select(F.col("id").alias(c), F.col("path").alias(to))), c)
    weights = named(named(weights, "src_module", "src"), "dst_module", "dst")
    return names, weights.select("src", "dst", "weight")


def structure_of(graph: Graph, *, uses_mode: str = "all") -> Structure:
    """The module view of a resolved graph. Containment, weights and components are found once and shared."""
    graph = apply_uses_mode(graph, uses_mode).stored()
    contained = materialize(modules.containing_modules(graph), "contained")
    weights = materialize(modules.coupling_weights(graph, contained), "weights")
    quotient = modules.module_graph(graph, contained, weights).stored()
    parts = materialize(scc.components(quotient), "parts")
    names, dependencies = _dependencies(graph, weights)

    def radii() -> DataFrame:
        named = lambda df, c, to: df.join(shuffled(names.select(F.col("id").alias(c), F.col("path").alias(to))), c)
        found = modules.module_radii(graph, contained).withColumnsRenamed({"module": "m", "other": "o"})
        return named(named(found, "m", "module"), "o", "other").select("module", "direction", "other")

    return Structure(names, dependencies, scc.cycles(parts), dsm_order(quotient, parts), radii)


def analyse_structure(graph: Graph, *, scope: str = "full", uses_mode: str = "all") -> Structure:
    return structure_of(prepare(graph, scope), uses_mode=uses_mode)


@dataclass(frozen=True)
class Workspace:
    graph: Graph
    ghosts: DataFrame
    failures: DataFrame  # (label, reason)


def build_workspace(graphs: dict[str, Graph]) -> Workspace:
    """Resolve each labelled graph and unite them; one with an undecided collision is left out and reported."""
    kept, failed = [], []
    for label, graph in graphs.items():
        try:
            graph = resolve.resolve(graph)
        except Undecided as e:
            failed.append((label, str(e)))
            continue
        kept.append(Graph(graph.nodes.withColumn("label", F.lit(label)), graph.edges.withColumn("label", F.lit(label))))
    if not kept:
        raise GraphError("no graph of the workspace could be resolved")
    merged = Graph(reduce(DataFrame.unionByName, [g.nodes for g in kept]), reduce(DataFrame.unionByName, [g.edges for g in kept]))
    united = workspace.unite(merged)
    failures = merged.nodes.sparkSession.createDataFrame(failed, "label string, reason string")
    return Workspace(united.graph, united.ghosts, failures)


def analyse_diff(graph: Graph, ranges: DataFrame, files: DataFrame, member_dirs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(touched, untracked census, reach of all touched nodes)."""
    touched = materialize(diffing.touched_nodes(graph, ranges), "touched")
    return touched, diffing.untracked_census(graph, files, member_dirs), diffing.touched_radius(graph, touched)


@dataclass(frozen=True)
class Comparison:
    pairs: DataFrame
    deltas: DataFrame
    items: DataFrame  # one row for each key
    removed_third_party: tuple[int, int]
    mode: str = "normalized"
    natures: tuple[str, str] = ("package", "package")
    item_rows: tuple[DataFrame, DataFrame] | None = None  # each item of both sides with its key


def pairing_mode(before: str, after: str) -> str:
    """Full paths where a root is a workspace; a package's own name may have changed from one side to the other."""
    return "full_path" if "workspace" in (before, after) else "normalized"


def side_label(root: str) -> str:
    """What a side of a comparison is called: the name of its folder, "workspace" where that has none."""
    return os.path.basename(os.path.realpath(root)) or "workspace"


def analyse_comparison(
    before: Graph, after: Graph, *, natures: tuple[str, str] = ("package", "package"), mode: str | None = None, scope: str = "own_code", uses_mode: str = "all", members: tuple[DataFrame, DataFrame] | None = None, ghosts: tuple[DataFrame, DataFrame] | None = None
) -> Comparison:
    """Two resolved graphs side by side; members limits each side to its own crates, ghosts (path) are no items of theirs.

    natures: "package" or "workspace" for each side; they choose how modules are paired unless mode does.
    """
    mode = mode or pairing_mode(*natures)
    sides, removed = [], []
    for k, graph in enumerate((before, after)):
        graph = apply_scope(graph, scope)
        if members is not None:
            kept = keep_members(graph, members[k])
            removed.append(graph.nodes.count() - kept.nodes.count())
            graph = kept
        else:
            removed.append(0)
        sides.append(graph.stored())
    # A comparison needs the modules and their dependencies only, not their cycles, order and radii.
    used = [apply_uses_mode(g, uses_mode) for g in sides]
    (modules_before, deps_before), (modules_after, deps_after) = (_dependencies(g, modules.coupling_weights(g, materialize(modules.containing_modules(g), "contained"))) for g in used)
    pairs = compare.module_pairs(modules_before, modules_after, mode)
    items = [materialize(compare.item_keys(g, missing), "items") for g, missing in zip(sides, ghosts or (None, None))]
    return Comparison(pairs, compare.edge_deltas(deps_before, deps_after, pairs, mode), compare.item_pairs(*items), (removed[0], removed[1]), mode, natures, (items[0], items[1]))
