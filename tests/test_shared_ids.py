"""Workspaces in which customers and suppliers share ids: drawn without broadcasts of customers, measured as the SQL does."""

import random
import re

import duckdb
import pytest

from test_driver_load import plans  # noqa: F401
from undertow import analysis_queries, measure_queries
from undertow.operators import ranking
from undertow.sources import projections as P

SHARED = 1_000_000


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(7), str(tmp_path_factory.mktemp("shared-ids"))
    customers, suppliers = [*range(1, 40), *range(SHARED + 1, SHARED + 40)], [*range(1, 45)]
    rows = {
        "region": ([(k, f"r{k}") for k in range(4)], "r_regionkey int, r_name string"),
        "nation": ([(k, k // 2) for k in range(8)], "n_nationkey int, n_regionkey int"),
        "customer": ([(k, rng.choice([2, 4, 5, 6])) for k in customers], "c_custkey long, c_nationkey int"),
        "supplier": ([(k, rng.choice([1, 4, 5, 7])) for k in suppliers], "s_suppkey long, s_nationkey int"),
        "part": ([(1,)], "p_partkey long"),
        "orders": ([(k, rng.choice(customers)) for k in range(90)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(rng.randrange(90), rng.choice(suppliers), k % 5, rng.choice("RAN")) for k in range(160)], "l_orderkey long, l_suppkey long, l_linenumber long, l_returnflag string"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def keys_sent(plan):
    """The keys of joins that send one side through the driver."""
    return re.findall(r"BroadcastHashJoin \[.*?\], \[.*?\]", plan)


@pytest.mark.parametrize(("queries", "name", "one_mask"), [(analysis_queries, "radii_in_workspace", 0), (measure_queries, "radius_in_workspace", 64)])
def test_a_shared_id_is_one_node(spark, tables, monkeypatch, queries, name, one_mask):
    monkeypatch.setattr(ranking, "ONE_MASK", one_mask)
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    found = queries.QUERIES[name](spark, tables)
    want = con.sql(f"select {', '.join(found.columns)} from ({queries.SQL[name]}) q").fetchall()
    assert want and sorted(map(tuple, found.collect())) == sorted(want)


def test_traders_do_not_pass_through_the_driver(spark, tables, plans):  # noqa: F811
    P.crates(spark, tables)
    assert len(plans) == 3 and "custkey" in plans[2] and not [k for p in plans for k in keys_sent(p) if "custkey" in k or "[id#" in k]


def test_customers_of_the_market_do_not_either(spark, tables):
    graph = P.market_graph(spark, tables)
    for df in (graph.nodes, graph.edges):
        text = df._jdf.queryExecution().sparkPlan().toString()
        assert "custkey" in text and not [k for k in keys_sent(text) if "custkey" in k]
