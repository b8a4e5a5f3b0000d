"""Graphs through JSON leave no documents behind, and are checked by one shuffle."""

import glob

import duckdb

from undertow import measure_queries
from undertow.graph import Graph
from undertow.runtime import shared_dir
from undertow.sources.json_graph import violations


def test_documents_are_compressed_and_go(spark, tmp_path, monkeypatch):
    rows = [(k // 5, k % 5 + 1, "RAN"[k % 3]) for k in range(60)] + [(3, 1, "R"), (4, 2, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    there, read = [], measure_queries.read_graph

    def seen(spark, folder, **kw):
        there.extend(glob.glob(f"{folder}/part-*"))
        return read(spark, folder, **kw)

    monkeypatch.setattr(measure_queries, "read_graph", seen)
    for name in ("json_nodes", "json_edges"):
        found = measure_queries.QUERIES[name](spark, str(tmp_path))
        want = con.sql(f"select {', '.join(found.columns)} from ({measure_queries.SQL[name]}) q").fetchall()
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert there and all(f.endswith(".gz") for f in there)
    assert not glob.glob(f"{shared_dir(spark).removeprefix('file:')}/documents-*")


def test_ends_are_counted_in_one_shuffle(spark):
    nodes = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (None, "a"), (3, None), (4, "b")]
    edges = [(1, 2, "a"), (1, 9, "a"), (9, 9, "a"), (4, 4, "a"), (None, 2, "a"), (3, 3, None), *[(7, 4, "b")] * 25_003]
    nodes = spark.createDataFrame(nodes, "id long, label string").selectExpr("*", "'p' path", "'p' name", "'fn' kind")
    graph = Graph.of(nodes, spark.createDataFrame(edges, "src long, dst long, label string").selectExpr("*", "'uses' relation"))
    found = violations(graph)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1
    got = {(r["rule"], r["value"]): r["count"] for r in found.groupBy("rule", "value").count().collect()}
    assert got == {
        ("missing id", ""): 1, ("duplicate id", "1"): 1, ("dangling dst", "9"): 2, ("dangling src", "9"): 1, ("dangling src", "4"): 1, ("dangling dst", "4"): 1,
        ("dangling src", None): 1, ("dangling src", "3"): 1, ("dangling dst", "3"): 1, ("dangling src", "7"): 25_003,
    }
