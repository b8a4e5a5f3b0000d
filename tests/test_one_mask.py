"""Up to 64 starts are searched without components, with the results of the search over components."""

import random

import pytest

from undertow.graph import Graph
from undertow.operators import modules, ranking


def random_graph(spark, seed):
    """Modules with items, cycles, loops and parallel edges."""
    rng = random.Random(seed)
    nodes = [(0, "a", "crate"), *((k, f"a::m{k}", "mod") for k in range(1, 8)), *((k, f"a::m::f{k}", "fn") for k in range(8, 40))]
    owns = [(0, k, "owns") for k in range(1, 8)] + [(rng.randrange(1, 8), k, "owns") for k in range(8, 38)]
    uses = [(rng.randrange(40), rng.randrange(40), "uses") for _ in range(60)]
    return Graph.of(spark.createDataFrame(nodes, "id long, path string, kind string"), spark.createDataFrame(owns + uses + uses[:9], "src long, dst long, relation string")).stored()


def _refuse(*_):
    raise AssertionError("components were searched")


@pytest.mark.parametrize("seed", [1])
def test_radii_of_few_modules_need_no_components(spark, monkeypatch, seed):
    graph = random_graph(spark, seed)
    contained = modules.containing_modules(graph)
    rows = lambda: sorted(map(tuple, modules.module_radii(graph, contained).collect()))
    with monkeypatch.context() as m:
        m.setattr(modules, "ONE_MASK", 0)
        want = rows()
    monkeypatch.setattr(modules, "components", _refuse)
    assert want and rows() == want


def test_sizes_of_few_targets_need_no_components(spark, monkeypatch):
    graph = random_graph(spark, 5)
    targets = graph.nodes.filter("id % 9 = 0").select("id")
    rows = lambda: sorted(map(tuple, ranking.reach_sizes(graph, targets).collect()))
    with monkeypatch.context() as m:
        m.setattr(ranking, "ONE_MASK", 0)
        want = rows()
    monkeypatch.setattr(ranking, "components", _refuse)
    assert len(want) == 10 and rows() == want
