"""Lines are joined once for all labelled graphs, with the rows of the SQL on ids that customers and suppliers share."""

import random

from undertow import queries as Q
from undertow.sources import projections as P


def test_lines_are_joined_once(spark, tmp_path):
    rng = random.Random(3)
    customers, suppliers = [*range(1, 30), *range(1_000_001, 1_000_030)], [*range(1, 45)]
    nation = lambda: rng.choice([0, 1, 2, 3, 4, 5, 9, None])
    rows = {
        "region": ([(k, f"r{k}") for k in range(3)], "r_regionkey int, r_name string"),
        "nation": ([(k, k // 2) for k in range(6)], "n_nationkey int, n_regionkey int"),
        "customer": ([(k, nation()) for k in [*customers, 5, 1_000_007]], "c_custkey long, c_nationkey int"),  # two of them twice
        "supplier": ([(k, nation()) for k in [*suppliers, 7]], "s_suppkey long, s_nationkey int"),
        "part": ([(1,)], "p_partkey long"),
        "orders": ([(k, rng.choice([*customers, None])) for k in range(300)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(rng.randrange(310), rng.choice([*suppliers, None]), k % 5, rng.choice("RAN")) for k in range(1500)], "l_orderkey long, l_suppkey long, l_linenumber long, l_returnflag string"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = Q._labelled(spark, str(tmp_path))
    assert "Join" not in found.edges._jdf.queryExecution().optimizedPlan().toString()
    nodes = found.nodes.selectExpr("label", "id", "path", "kind", "position.file file")
    shared = nodes.groupBy("label", "id").count().filter("count > 1").count()
    for got, sql in ((nodes, P.CRATE_NODES), (found.edges.select("label", "src", "dst", "relation", "uses_kind"), P.CRATE_EDGES)):
        want = P.select(spark, str(tmp_path), sql)
        assert want.columns == got.columns and shared and got.count()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
