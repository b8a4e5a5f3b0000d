"""Edges that a search reads at every hop are dealt once."""

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from test_one_mask import random_graph
from undertow.operators import modules, ranking
from undertow.runtime import stored_by


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_stay_where_they_are(spark):
    stored = stored_by(spark.createDataFrame([(k % 7, k % 3) for k in range(50)], "src long, dst long"), "src", "between")
    assert stored.count() == 21 and not [t.name for t in spark.catalog.listTables() if t.name.startswith("between")]
    met = stored.join(spark.createDataFrame([(3,), (9,)], "src long").hint("shuffle_hash"), "src")
    assert plan(met).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, met.collect())) == [(3, 0), (3, 1), (3, 2)]


@pytest.mark.parametrize("search", ["sizes", "radii"])
def test_hops_do_not_shuffle_edges(spark, monkeypatch, search):
    graph = random_graph(spark, 5)
    plans, write = [], DataFrameWriter.parquet

    def parquet(self, *a, **kw):
        plans.append(plan(self._df))
        return write(self, *a, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    if search == "sizes":
        ranking.reach_sizes(graph, graph.nodes.filter("id % 9 = 0").select("id"))
    else:
        modules.module_radii(graph, modules.containing_modules(graph))
    assert [p for p in plans if p.count("SelectedBucketsCount") >= 3]  # three hops to a job
