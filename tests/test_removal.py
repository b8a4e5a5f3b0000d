"""Nodes are removed without sorting the edges in a task and without broadcasting ids."""

from test_driver_load import _graph, plan

from undertow.operators import filters


def test_removed_ids_are_hashed_by_share(spark):
    graph = _graph(spark)
    kept = filters.without(graph, graph.nodes.filter("id in (3, 4)"))
    assert {r["id"] for r in kept.nodes.collect()} == {0, 1, 2, 5}
    assert sorted((r["src"], r["dst"]) for r in kept.edges.collect()) == [(0, 1), (1, 2), (2, 5), (5, 2)]
    for df, joins in ((kept.nodes, 1), (kept.edges, 2)):
        text = plan(df)
        assert text.count("ShuffledHashJoin") == joins
        assert "SortMergeJoin" not in text and "Broadcast" not in text
