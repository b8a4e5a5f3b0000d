"""Texts and documents of results, on small frames."""

import json

from pyspark.sql import functions as F

from undertow.graph import Graph
from undertow.operators import compare, measures
from undertow.plans.analyses import Comparison, pairing_mode, side_label
from undertow.render import comparison_json, comparison_lines, comparison_text, diff_json, diff_text
from undertow.sources.catalog import find_package, read_metadata


def test_pairing_and_labels(tmp_path):
    assert pairing_mode("package", "package") == "normalized"
    assert pairing_mode("package", "workspace") == "full_path"
    assert side_label(str(tmp_path)) == tmp_path.name and side_label("/") == "workspace"


def test_comparison_text(spark):
    pairs = spark.createDataFrame([("m", "a::m", "b::m"), ("n", "a::n", None)], "key string, path_before string, path_after string")
    deltas = spark.createDataFrame([("m", "o", 1, 5), ("m", "p", 2, None), ("m", "q", 3, 3)], "src_key string, dst_key string, weight_before long, weight_after long")
    rows = [spark.createDataFrame(x, "kind string, `trait` string, name string, path string") for x in ([("fn", "", "f", "a::f"), ("fn", "", "g", "a::g")], [("fn", "", "f", "b::f")])]
    comparison = Comparison(pairs, deltas, compare.item_pairs(*rows), (0, 2), item_rows=tuple(rows))
    text = comparison_text(comparison, "old", "new").split("\n")
    assert text[1:5] == ["modules: 1 paired, 1 only before, 0 only after", "dependencies: 2 common, 1 gone, 0 new", "items: 1 paired, 0 ambiguous, 1 only before, 0 only after", "third-party nodes left out: 0 before, 2 after"]
    assert "  m -> o: 1 -> 5" in text and "  m -> p (2)" in text and "  a: 1 before, 0 after" in text and not any("q" in t for t in text)
    document = json.loads(comparison_json(comparison, "old", "new"))
    assert document["items"]["paired"] == [{"kind": "fn", "trait": "", "name": "f", "before": ["a::f"], "after": ["b::f"]}] and [x["before"] for x in document["items"]["only_before"]] == [["a::g"]]
    lines = {(r["part"], r["value"]) for r in comparison_lines(comparison).collect()}
    assert ("only_before", '{"side":"before","kind":"fn","trait":"","name":"g","path":"a::g"}') in lines and len(lines) == 7


def test_diff_views(spark):
    touched = spark.createDataFrame([(1, "c::a"), (2, "c")], "id long, path string")
    found = spark.createDataFrame([(1, "downstream", 3, 1), (2, "downstream", 3, 2)], "target long, direction string, node long, depth long")
    census = spark.createDataFrame([("x/new.rs", "linked"), ("x/b.txt", "non_source")], "file string, bucket string")
    names = spark.createDataFrame([(3, "d::z")], "id long, path string")
    paths = found.join(names.withColumnRenamed("id", "node"), "node")
    lines = diff_text(touched, census, paths).split("\n")
    assert lines == ["downstream: d 2", "upstream: -", "untracked, linked: 1 (new.rs)", "untracked, loose: 0", "untracked, non source: 1 (b.txt)"]
    assert diff_text(touched, census, paths, "layers").split("\n")[0] == "c: a, c"
    classes = touched.select("id", F.lit("leaf").alias("class"))
    document = json.loads(diff_json(touched, classes, found, names, census))
    assert document["combined"] == {"upstream": [], "downstream": [{"path": "d::z", "depth": 1}]}
    assert document["touched"][0] == {"path": "c", "id": 2, "class": "leaf", "upstream": 0, "downstream": 1}
    assert document["linked"] == ["x/new.rs"] and document["ghosts"] == []


def test_metadata_reader(spark, tmp_path):
    file = tmp_path / "metadata.json"
    file.write_text(json.dumps({"packages": [{"name": "a", "manifest_path": "/w/a/Cargo.toml", "targets": [{"name": "a", "kind": ["bin"]}], "other": 1}]}))
    row = find_package(read_metadata(spark, str(file)), manifest="/w/a/Cargo.toml").first()
    assert (row["name"], row["target"]) == ("a", "bin:a")


def test_keys_and_owners_in_a_ring(spark):
    nodes = spark.createDataFrame([(1, "c::T", "struct"), (2, "c::T::f", "fn"), (3, "c::f", "fn")], "id long, path string, kind string")
    edges = spark.createDataFrame([(1, 2, "owns"), (2, 1, "owns")], "src long, dst long, relation string")
    graph = Graph.of(nodes, edges)
    names = lambda key: {(r["name"], r["count"]) for r in compare.item_keys(graph, key=key).groupBy("name").count().collect()}
    assert names("name") == {("T", 1), ("f", 2)} and names("owner_name") == {("T", 1), ("T::f", 1), ("f", 1)}
    assert {tuple(r) for r in measures.ancestors(graph, nodes.filter("id = 2").select("id")).collect()} == {(2, 1, 1)}
