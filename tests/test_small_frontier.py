"""A small frontier travels to many edges, which are not shuffled for each hop, with the same reach."""

from test_driver_load import _graph, plans  # noqa: F401

from undertow.operators import reach


def test_few_rows_meet_many_edges(spark, plans, monkeypatch):  # noqa: F811
    graph, targets = _graph(spark), spark.createDataFrame([(3,), (2,)], "id long")
    rows = lambda: sorted(map(tuple, reach.impact_reach(graph, targets).collect()))
    want = rows()
    plans.clear()
    monkeypatch.setattr(reach, "_MANY", 0)
    assert rows() == want and len(want) == 5
    hops = [p for p in plans if "BroadcastHashJoin" in p]
    assert hops and all(p.count("BroadcastHashJoin") == 1 for p in hops)
