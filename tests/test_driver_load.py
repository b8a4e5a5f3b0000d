"""Joins over tables with a row for a node, edge or pair never pass one side through the driver, however small a test is."""

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from undertow.graph import Graph
from undertow.operators import modules, ranking, reach


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are written meanwhile."""
    seen, write = [], DataFrameWriter.parquet

    def parquet(self, *a, **kw):
        seen.append(plan(self._df))
        return write(self, *a, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return seen


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def _graph(spark):
    nodes = spark.createDataFrame([(0, "a", "crate"), (1, "a::m", "mod"), (2, "a::m::x", "struct"), (3, "a::m::x::f", "fn"), (4, "a::n", "mod"), (5, "a::n::y", "fn")], "id long, path string, kind string")
    edges = [(0, 1, "owns"), (1, 2, "owns"), (2, 3, "owns"), (0, 4, "owns"), (4, 5, "owns"), (3, 5, "uses"), (5, 2, "uses"), (2, 5, "uses")]
    return Graph.of(nodes, spark.createDataFrame(edges, "src long, dst long, relation string")).stored()


def _none_broadcast(plans):
    assert plans
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoop" in p]


def test_containment_is_not_broadcast(spark, plans):
    graph = _graph(spark)
    contained = modules.containing_modules(graph)
    assert {tuple(r) for r in contained.collect()} == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    _none_broadcast(plans)


def test_weights_are_not_broadcast(spark, plans):
    graph = _graph(spark)
    weights = modules.coupling_weights(graph, modules.containing_modules(graph))
    assert {tuple(r) for r in weights.collect()} == {(1, 4, 2), (4, 1, 1)}
    _none_broadcast([*plans, plan(weights)])


def test_sizes_of_reach_without_pairs(spark, plans):
    graph, targets = _graph(spark), spark.createDataFrame([(2,), (3,), (0,)], "id long")
    sizes = ranking.reach_sizes(graph, targets)
    assert {tuple(r) for r in sizes.collect()} == {(2, "downstream", 1), (2, "upstream", 2), (3, "downstream", 2), (3, "upstream", 0), (0, "downstream", 0), (0, "upstream", 0)}
    _none_broadcast([p for p in plans if "part__" not in p])  # numbering joins one row for each partition


def test_reach_is_not_broadcast(spark, plans):
    starts = spark.createDataFrame([(3, 3)], "target long, node long")
    found = reach.reach(_graph(spark).uses(), starts, "downstream")
    assert {tuple(r) for r in found.collect()} == {(3, 5, 1), (3, 2, 2)}
    _none_broadcast(plans)


def test_ranking_is_not_broadcast(spark, plans):
    assert {r["path"]: r["impact"] for r in ranking.impacts(_graph(spark)).collect()}["a::n::y"] == 2
    _none_broadcast(plans)
