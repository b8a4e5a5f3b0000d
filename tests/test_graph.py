"""Operators on hand-built graphs."""

import json

import pytest
from pyspark.sql import functions as F

from undertow.graph import Graph
from undertow.operators import compare, degrees, diffing, filters, modules, ranking, reach, resolve, scc, workspace
from undertow.operators.dsm import dsm_order
from undertow.plans.analyses import analyse_comparison, build_workspace, structure_of
from undertow.render import fill_template, radii_by_index, structure_json
from undertow.schema import InvalidGraph, TargetNotFound, Undecided, UntypedUses
from undertow.sources.catalog import chosen_target, root_nature, workspace_members
from undertow.sources.diff_text import parse_diff
from undertow.sources.json_graph import read_graph
from undertow.sources.store import content_key, load_graph, save_graph

U, O = "uses", "owns"


def graph(spark, nodes, edges, extra=""):
    """nodes: (id, path, kind[, trait, trait_ref]); edges: (src, relation, dst[, kind])."""
    n = spark.createDataFrame([(*x, None, None)[:5] for x in nodes], "id long, path string, kind string, `trait` string, trait_ref string")
    e = spark.createDataFrame([(i, x[0], x[2], x[1], x[3] if len(x) > 3 else None) for i, x in enumerate(edges)], "edge_seq long, src long, dst long, relation string, uses_kind string")
    return Graph.of(n, e)


def mods(spark, paths, arrows):
    ids = {p: i for i, p in enumerate(paths)}
    return graph(spark, [(i, p, "mod") for p, i in ids.items()], [(ids[a], U, ids[b]) for a, b in arrows])


def order_of(g):
    rows = dsm_order(g, scc.components(g)).orderBy("ordinal").collect()
    return [r["path"] for r in rows], [r["block"] for r in rows]


def test_ranking(spark):
    g = graph(spark, [(i, f"meu::{n}", "fn") for i, n in enumerate(["base", "meio", "a", "b", "c"], 1)], [(3, U, 1), (4, U, 1), (5, U, 1), (3, U, 2), (2, U, 1)])
    rows = ranking.rank_nodes(g, 9).orderBy("position").collect()
    assert [(r["path"], r["impact"]) for r in rows] == [("meu::base", 4), ("meu::meio", 1), ("meu::a", 0), ("meu::b", 0), ("meu::c", 0)]
    assert ranking.rank_nodes(g, 0).count() == 0


K2 = [(1, "k", "crate"), (10, "k::a", "mod"), (11, "k::a::f", "fn"), (13, "k::a::g", "fn"), (20, "k::b", "mod"), (21, "k::b::h", "fn"), (99, "lost", "fn")]
K2_OWNS = [(1, O, 10), (10, O, 11), (10, O, 13), (1, O, 20), (20, O, 21)]


def test_containment_and_weights(spark):
    g = graph(spark, K2, [*K2_OWNS, (11, U, 21), (13, U, 21), (21, U, 11), (11, U, 13)])
    inside = modules.containing_modules(g)
    assert {(r["id"], r["module"]) for r in inside.collect()} == {(1, 1), (10, 10), (20, 20), (11, 10), (13, 10), (21, 20)}
    assert {tuple(r) for r in modules.coupling_weights(g, inside).collect()} == {(10, 20, 2), (20, 10, 1)}


def test_owners_in_a_ring_have_no_module(spark):
    g = graph(spark, [(1, "a", "fn"), (2, "b", "fn")], [(1, O, 2), (2, O, 1)])
    assert modules.containing_modules(g).count() == 0


def test_module_radius_is_exact(spark):
    nodes = [(100, "k::a", "mod"), (1, "k::a::1", "fn"), (200, "k::b", "mod"), (2, "k::b::2", "fn"), (3, "k::b::3", "fn"), (300, "k::c", "mod"), (4, "k::c::4", "fn")]
    g = graph(spark, nodes, [(100, O, 1), (200, O, 2), (200, O, 3), (300, O, 4), (1, U, 2), (3, U, 4)])
    rows = modules.module_radii(g, modules.containing_modules(g)).collect()
    assert {tuple(r) for r in rows} == {(100, "downstream", 200), (200, "downstream", 300), (200, "upstream", 100), (300, "upstream", 200)}


@pytest.mark.parametrize(
    "paths, arrows, order, blocks",
    [
        ("abc", ["ab", "bc"], "abc", [None] * 3),
        ("abc", ["ab", "ba", "ca"], "cab", [None, 0, 0]),
        ("abcd", ["ab", "ba", "cd", "dc"], "abcd", [0, 0, 1, 1]),
        ("abc", ["ab"], "abc", [None] * 3),
        ("abc", ["ab", "bc", "ca"], "abc", [0, 0, 0]),
    ],
)
def test_dsm_order(spark, paths, arrows, order, blocks):
    assert order_of(mods(spark, paths, [tuple(a) for a in arrows])) == (list(order), blocks)


def test_self_loop_is_no_cycle(spark):
    g = graph(spark, [(1, "a", "fn")], [(1, U, 1)])
    assert scc.cycles(scc.components(g)).count() == 0
    row = degrees.classification(g).first()
    assert (row["uses_in"], row["uses_out"], row["class"]) == (1, 1, "intermediate")
    about, found = reach.radius(g, path="a")
    assert found.count() == 0


def test_degrees_count_parallel_edges(spark):
    g = graph(spark, [(1, "x", "fn"), (2, "y", "fn")], [(1, U, 2, "reference"), (1, U, 2, "import")])
    assert degrees.degrees(g).filter("id = 2").first()["uses_in"] == 2
    with pytest.raises(TargetNotFound):
        reach.radius(g, path="z")


def test_collisions_by_trait(spark):
    nodes = [(1, "t", "crate"), (10, "t::T", "struct"), (20, "t::T::fmt", "fn", "Display"), (21, "t::T::fmt", "fn", "Debug"), (30, "t::u", "fn"), (31, "t::v", "fn")]
    g = resolve.resolve(graph(spark, nodes, [(10, O, 20), (10, O, 21), (30, U, 20), (31, U, 21)]))
    assert {r["path"] for r in g.nodes.collect()} == {"t", "t::T", "t::T::<Display>::fmt", "t::T::<Debug>::fmt", "t::u", "t::v"}


@pytest.mark.parametrize(
    "traits, names",
    [
        ([("From", "From<&str>"), ("From", "From<String>")], ["M::<From<&str>>::f", "M::<From<String>>::f"]),
        ([(None, None), (None, None)], ["M::f#1", "M::f#2"]),
        ([("Display", None), ("From", "From<&str>"), ("From", "From<u32>")], ["M::<Display>::f", "M::<From<&str>>::f", "M::<From<u32>>::f"]),
        ([("D", None), (None, None)], ["M::<D>::f", "M::f#2"]),
    ],
)
def test_ladder(spark, traits, names):
    nodes = [(i, "M::f", "fn", *t) for i, t in enumerate(traits, 1)] + [(50, "p", "fn")]
    g = resolve.resolve(graph(spark, nodes, [(50, U, i) for i in range(1, len(traits) + 1)]))
    assert [r["path"] for r in g.nodes.filter("id < 50").orderBy("id").collect()] == names


def test_same_item_and_undecided(spark):
    nodes = [(1, "a::x", "fn"), (2, "a::x", "fn"), (3, "b", "fn")]
    merged = resolve.resolve(graph(spark, nodes, [(1, U, 2), (3, U, 3), (3, U, 3, "import")]))
    assert {r["id"] for r in merged.nodes.collect()} == {1, 3}
    assert sorted((r["src"], r["dst"]) for r in merged.edges.collect()) == [(1, 1), (3, 3)]
    with pytest.raises(Undecided):
        resolve.resolve(graph(spark, nodes, []))


def test_scope_and_uses_mode(spark):
    g = graph(spark, [(1, "m", "crate"), (2, "core::fmt", "mod"), (3, "core_extras::x", "fn")], [(1, U, 2, "reference"), (3, U, 1, "import")])
    own = filters.apply_scope(g, "own_code")
    assert {r["path"] for r in own.nodes.collect()} == {"m", "core_extras::x"} and own.edges.count() == 1
    assert filters.apply_uses_mode(g, "reference_only").edges.count() == 1
    with pytest.raises(UntypedUses):
        filters.apply_uses_mode(graph(spark, [(1, "m", "crate")], [(1, U, 1)]), "reference_only")
    kept = filters.keep_members(g, spark.createDataFrame([("core-extras",)], "name string"))
    assert [r["path"] for r in kept.nodes.collect()] == ["core_extras::x"] and kept.edges.count() == 0


def test_structure_modes(spark):
    g = graph(spark, K2[:-1], [*K2_OWNS, (11, U, 21, "reference"), (20, U, 11, "import")])
    both = structure_of(g)
    assert [r["members"] for r in both.cycles.collect()] == [["k::a", "k::b"]]
    assert structure_of(g, uses_mode="reference_only").cycles.count() == 0
    document = json.loads(structure_json(both))
    assert document["order"] == ["k", "k::a", "k::b"] and document["blocks"] == [["k::a", "k::b"]]
    assert {tuple(r["others"]) for r in radii_by_index(both).collect()} == {(1,), (2,)}


def labelled(spark, rows, edges):
    nodes = spark.createDataFrame(rows, "label string, id long, path string, file string")
    nodes = nodes.withColumn("kind", F.lit("struct")).withColumn("position", F.when(F.col("file").isNotNull(), F.struct("file", F.lit(1).alias("start_line"), F.lit(2).alias("end_line")))).drop("file")
    return Graph.of(nodes, spark.createDataFrame(edges, "label string, src long, dst long, relation string"))


def test_union_and_ghosts(spark):
    rows = [("a", 1, "a", None), ("a", 2, "a::usa", None), ("a", 3, "b::Foo", None), ("b", 1, "b", None), ("b", 2, "b::Foo", "b.rs"), ("a", 4, "b::Gone", None)]
    united = workspace.unite(labelled(spark, rows, [("a", 2, 3, "uses"), ("a", 2, 4, "uses"), ("b", 1, 2, "owns")]))
    nodes = {r["path"]: r for r in united.graph.nodes.collect()}
    assert [nodes[p]["id"] for p in sorted(nodes)] == [0, 1, 2, 3, 4] and nodes["b::Foo"]["position"]["file"] == "b.rs"
    assert {(r["src"], r["dst"]) for r in united.graph.edges.collect()} == {(1, 3), (1, 4), (2, 3)}
    assert [tuple(r) for r in united.ghosts.collect()] == [("b::Gone", ["a"])]


def test_workspace_reports_undecided_graphs(spark):
    good = graph(spark, [(1, "a", "crate")], [(1, U, 1)])
    bad = graph(spark, [(1, "b::x", "fn"), (2, "b::x", "fn")], [(1, U, 1)])
    made = build_workspace({"a": good, "b": bad})
    assert [r["label"] for r in made.failures.collect()] == ["b"] and made.graph.nodes.count() == 1


def placed(spark):
    nodes = spark.createDataFrame([(1, "a", "mod", "/abs/a/src/lib.rs", 1, 40), (2, "a::foo", "fn", "/abs/a/src/lib.rs", 10, 20), (3, "o", "fn", "/repo/a/outro_lib.rs", 1, 99)], "id long, path string, kind string, file string, start_line int, end_line int")
    nodes = nodes.withColumn("position", F.struct("file", "start_line", "end_line"))
    return Graph.of(nodes.drop("file", "start_line", "end_line"), spark.createDataFrame([(2, 1, "uses")], "src long, dst long, relation string"))


def test_touched(spark):
    ranges = lambda *r: spark.createDataFrame(list(r), "file string, start int, end int")
    hit = lambda *r: [x["path"] for x in diffing.touched_nodes(placed(spark), ranges(*r)).orderBy("path").collect()]
    assert hit(("a/src/lib.rs", 12, 14), ("src/lib.rs", 13, 13)) == ["a", "a::foo"]
    assert hit(("a/src/lib.rs", 30, 31)) == ["a"]
    assert hit(("lib.rs", 1, 5)) == ["a"]


def test_untracked_census(spark):
    files = spark.createDataFrame([("a/src/lib.rs", "untracked"), ("a/src/new.rs", "untracked"), ("x/y.rs", "untracked"), ("a/r.md", "untracked"), ("t.rs", "tracked")], "file string, origin string")
    rows = diffing.untracked_census(placed(spark), files, spark.createDataFrame([("a",)], "dir string")).collect()
    assert {tuple(r) for r in rows} == {("a/src/lib.rs", "linked"), ("a/src/new.rs", "loose"), ("x/y.rs", "non_source"), ("a/r.md", "non_source")}


def test_combined_radius(spark):
    found = spark.createDataFrame([(1, "upstream", 5, 1), (2, "upstream", 5, 3), (2, "upstream", 6, 2), (1, "downstream", 7, 1)], "target long, direction string, node long, depth long")
    assert {tuple(r) for r in reach.combined(found).collect()} == {("upstream", 5, 1), ("upstream", 6, 2), ("downstream", 7, 1)}


def test_comparison(spark):
    before = graph(spark, [(1, "velho", "crate"), (2, "velho::n", "mod"), (3, "velho::n::C", "struct"), (4, "velho::n::C::get", "fn"), (5, "velho::Foo", "struct"), (6, "velho::n::Foo", "struct")], [(1, O, 2), (2, O, 3), (3, O, 4), (1, O, 5), (2, O, 6), (4, U, 5)])
    after = graph(spark, [(1, "novo", "crate"), (2, "novo::n", "mod"), (7, "novo::z", "mod"), (3, "novo::z::C", "struct"), (4, "novo::z::C::get", "fn"), (5, "novo::Foo", "struct")], [(1, O, 2), (1, O, 7), (7, O, 3), (3, O, 4), (1, O, 5), (4, U, 5)])
    result = analyse_comparison(before, after)
    pairs = {r["key"]: (r["path_before"], r["path_after"]) for r in result.pairs.collect()}
    assert pairs == {"": ("velho", "novo"), "n": ("velho::n", "novo::n"), "z": (None, "novo::z")}
    assert {(r["src_key"], r["dst_key"], r["weight_before"], r["weight_after"]) for r in result.deltas.collect()} == {("n", "", 1, None)}
    status = {r["name"]: r["status"] for r in result.items.collect()}
    assert status == {"C": "paired", "C::get": "paired", "Foo": "ambiguous"}
    same = analyse_comparison(before, before)
    assert compare.unpaired_items(same.items, *same.item_rows).count() == 0 and same.deltas.filter("weight_before != weight_after or weight_after is null").count() == 0


def test_diff_text(spark):
    text = "+++ b/a.rs\n@@ -10,2 +10,3 @@ fn\n@@ -2 +2 @@\n@@ -10,3 +9,0 @@\n+++ /dev/null\n@@ -1 +1 @@\n+++ b/b.rs\r\n@@ -1 +6,1 @@"
    rows = parse_diff(spark.createDataFrame([(1, text), (2, None), (3, "")], "diff_id long, text string")).collect()
    assert {tuple(r) for r in rows} == {(1, "a.rs", 10, 12), (1, "a.rs", 2, 2), (1, "b.rs", 6, 6)}


def test_json_boundary_and_store(spark, tmp_path):
    node = {"id": 1, "path": "t", "name": "t", "kind": "const unsafe fn", "visibility": "pub(in a)", "cfg": {"x": 1}}
    edge = {"from": "t", "id_from": 1, "to": "t", "id_to": 1, "relation": "uses", "uses_kind": "odd"}

    def read(nodes, edges, name):
        file = tmp_path / f"{name}.json"
        file.write_text(json.dumps({"crate": "t", "nodes": nodes, "edges": edges}, indent=1))
        return read_graph(spark, str(file))

    g = read([node], [edge], "good")
    assert g.name == "t" and g.nodes.first()["kind"] == "fn" and g.nodes.first()["cfg"] == '{"x":1}' and g.edges.first()["uses_kind"] == "import"
    save_graph(g, str(tmp_path / "store"), "k1")
    assert load_graph(spark, str(tmp_path / "store"), "k1").edges.count() == 1
    for bad in (([node, node], [edge]), ([node], [edge | {"id_to": 7}]), ([node | {"kind": "what"}], []), ([node | {"visibility": "pub(in )"}], []), ([node], [edge | {"relation": "has"}])):
        with pytest.raises(InvalidGraph):
            read(*bad, name=str(abs(hash(str(bad)))))
    assert content_key([("a", b"bc")]) != content_key([("ab", b"c")])


def test_catalog(spark):
    dirs = spark.createDataFrame([("crates/a", "a"), ("crates/b", "b"), ("crates/virtual", None), ("tools/c", "c")], "dir string, name string")
    assert {r["name"] for r in workspace_members(dirs, ["crates/*", "tools/c"], ["crates/b"]).collect()} == {"a", "c"}
    targets = spark.createDataFrame([(1, [("x", ["bin"])]), (2, [("x", ["bin"]), ("y", ["lib"])]), (3, [("x", ["bin"]), ("z", ["bin"])])], "id int, targets array<struct<name:string,kind:array<string>>>")
    assert [r[0] for r in targets.orderBy("id").select(chosen_target(F.col("targets"))).collect()] == ["bin:x", "lib", None]
    assert root_nature({"workspace": {}, "package": {}}) == "package"
    assert fill_template("{a}-{b}", {"a": 1}) == "1-{b}"


def test_edge_feed_counts_a_batch_once(spark, tmp_path):
    from undertow.streaming import CHANGE_SCHEMA, EdgeFeed

    source = tmp_path / "in"
    spark.createDataFrame([(1, 2, 1), (1, 3, 1), (1, 2, -1)], CHANGE_SCHEMA).write.parquet(str(source))
    feed = EdgeFeed(spark, str(tmp_path / "store"))
    for _ in range(2):
        feed.start(spark.readStream.schema(CHANGE_SCHEMA).parquet(str(source)), str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in feed.degrees().collect()} == {(1, 0, 1), (2, 0, 0), (3, 1, 0)}


def test_documents_are_parsed_once(spark, tmp_path):
    file = tmp_path / "g.json"
    file.write_text('{"crate":"c","nodes":[{"id":1,"path":"c","name":"c","kind":"crate","visibility":"pub"}],"edges":[{"id_from":1,"id_to":1,"relation":"uses"}]}')
    g = read_graph(spark, str(file))
    file.unlink()
    assert [r["path"] for r in g.nodes.collect()] == ["c"] and g.edges.count() == 1


def test_structure_searches_radii_only_when_read(spark, monkeypatch):
    from undertow.operators import modules

    def refused(*_):
        raise AssertionError("nobody read the radii")

    monkeypatch.setattr(modules, "module_radii", refused)
    found = structure_of(graph(spark, K2[:-1], [*K2_OWNS, (11, U, 21, "reference"), (20, U, 11, "import")]))
    assert {(r["src"], r["dst"], r["weight"]) for r in found.dependencies.collect()} == {("k::a", "k::b", 1), ("k::b", "k::a", 1)}
    with pytest.raises(AssertionError):
        found.radii
