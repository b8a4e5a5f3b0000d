"""Plans that replaced a narrow one, against plain Python on random input."""

import heapq
import random
from types import SimpleNamespace

import pytest

from test_graph import O, U, graph, mods
from undertow.operators import diffing, modules, reach, scc
from undertow.operators.dsm import component_order, dsm_order
from undertow.operators.numbering import numbered
from undertow.operators.weak import weak_components
from undertow.render import folded, folded_matrix
from undertow.schema import GraphError
from undertow.sources.diff_text import parse_diff, parse_diff_lines, read_diffs
from undertow.sources.store import GraphStore, crate_keys


def one_heap(labels, arrows):
    waiting, after = dict.fromkeys(labels, 0), {n: [] for n in labels}
    for a, b in arrows:
        waiting[b] += 1
        after[a].append(b)
    ready, out = [n for n in labels if not waiting[n]], []
    heapq.heapify(ready)
    while ready:
        out.append(heapq.heappop(ready))
        for n in after[out[-1]]:
            waiting[n] -= 1
            if not waiting[n]:
                heapq.heappush(ready, n)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_parts_is_that_of_one_heap(spark, seed):
    rng = random.Random(seed)
    labels = [f"{rng.choice('abcdeÄ')}{k}" for k in range(150)]
    arrows = set()
    for k in range(0, 140, 7):  # groups of seven, some larger ones, some nodes alone
        group = rng.sample(labels, rng.choice([2, 4, 7]))
        arrows |= {(a, b) for i, a in enumerate(group) for b in group[i + 1 :] if rng.random() < 0.4}
    rank = {n: k for k, n in enumerate(rng.sample(labels, len(labels)))}
    arrows = {(a, b) if rank[a] < rank[b] else (b, a) for a, b in arrows}  # no cycle
    frame = component_order(spark.createDataFrame([(n,) for n in labels], "label string"), spark.createDataFrame(sorted(arrows), "src string, dst string"))
    assert [r["label"] for r in frame.orderBy("peak", "place").collect()] == one_heap(labels, arrows)


def test_matrix_of_many_parts(spark):
    rng = random.Random(4)
    paths = [f"m{k:02d}" for k in range(40)]
    g = mods(spark, paths, {(rng.choice(paths), rng.choice(paths)) for _ in range(45)})
    parts = scc.components(g)
    label = {r["path"]: r["label"] for r in parts.collect()}
    arrows = {(label[a], label[b]) for a, b in ((r["src_path"], r["dst_path"]) for r in g.with_paths().collect()) if label[a] != label[b]}
    order = one_heap(sorted(set(label.values())), arrows)
    want = sorted(paths, key=lambda p: (order.index(label[p]), p))
    rows = dsm_order(g, parts).orderBy("ordinal").collect()
    assert [r["path"] for r in rows] == want and [r["ordinal"] for r in rows] == list(range(40))
    sizes = [n for n in order if list(label.values()).count(n) > 1]
    assert [r["block"] for r in rows] == [sizes.index(label[p]) if label[p] in sizes else None for p in want]


def test_weak_components_and_numbers(spark):
    edges = [(k + 1, k) for k in range(50)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    found = dict(map(tuple, weak_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert found == {**{k: 0 for k in range(51)}, 100: 100, 101: 100, 102: 100}
    assert weak_components(spark.createDataFrame([], "src long, dst long")).isEmpty()
    rows = numbered(spark.createDataFrame([(f"{k * 7919 % 997:03d}",) for k in range(500)], "x string"), ["x"], "n").orderBy("x").collect()
    assert [r["n"] for r in rows] == list(range(500))


def arrows_of(rng, n, m):
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def distances(arrows, start, forward):
    near, depth, out = {start}, 0, {}
    while near:
        depth += 1
        near = {(b if forward else a) for a, b in arrows if (a if forward else b) in near} - {start, *out}
        out |= dict.fromkeys(near, depth)
    return out


@pytest.mark.parametrize(("seed", "n", "m", "starts"), [(1, 60, 90, 9), (2, 80, 80, 30), (3, 40, 200, 2), (4, 30, 45, 30), (5, 50, 60, 1)])
def test_combined_reach_is_the_least_over_all_targets(spark, seed, n, m, starts):
    rng = random.Random(seed)
    arrows, starts = arrows_of(rng, n, m), rng.sample(range(n), starts)
    g = graph(spark, [(k, f"p{k}", "fn") for k in range(n)], [(a, U, b) for a, b in arrows])
    got = {(r["direction"], r["node"]): r["depth"] for r in reach.combined_radius(g, spark.createDataFrame([(s,) for s in starts], "id long")).collect()}
    want = {}
    for direction in ("upstream", "downstream"):
        for s in starts:
            for node, d in distances(arrows, s, direction == "downstream").items():
                want[direction, node] = min(d, want.get((direction, node), d))
    assert got == want


def test_module_radii_by_masks(spark):
    rng = random.Random(8)
    n_modules, items = 70, 210  # more modules than one mask has bits
    arrows = [(rng.randrange(items), rng.randrange(items)) for _ in range(190)]
    nodes = [(1000 + k, f"m{k}", "mod") for k in range(n_modules)] + [(k, f"m{k % n_modules}::f{k}", "fn") for k in range(items)]
    g = graph(spark, nodes, [(1000 + k % n_modules, O, k) for k in range(items)] + [(a, U, b) for a, b in arrows])
    got = {tuple(r) for r in modules.module_radii(g, modules.containing_modules(g)).select("module", "direction", "other").collect()}
    want = set()
    for k in range(items):
        for direction in ("upstream", "downstream"):
            want |= {(1000 + k % n_modules, direction, 1000 + x % n_modules) for x in distances(arrows, k, direction == "downstream")}
    assert got == {w for w in want if w[0] != w[2]}


def test_touched_nodes_by_ends_and_bins(spark):
    rng = random.Random(6)
    files = ["/w/a/src/lib.rs", "/w/b/src/lib.rs", "/w/b/src/x.rs", "lib.rs", "b/src/lib.rs", "/w/bb/src/lib.rs"]
    at = lambda: rng.choice([rng.randrange(1, 40), rng.randrange(1, 5000), rng.randrange(1, 2_000_000_000)])
    span = lambda: (lambda a: (a, a + rng.choice([0, 3, 17, 300, 70_000])))(at())
    nodes = [(k, f"p{k}", rng.choice(files), *span()) for k in range(300)]
    ranges = [(rng.choice(["a/src/lib.rs", "src/lib.rs", "lib.rs", "b/src/x.rs", "rc/lib.rs", "/w/b/src/lib.rs"]), *span()) for _ in range(60)]
    frame = spark.createDataFrame(nodes, "id long, path string, file string, a int, b int")
    frame = frame.selectExpr("id", "path", "'fn' kind", "struct(file, a as start_line, b as end_line) position")
    g = graph(spark, [(1, "x", "fn")], []).with_nodes(frame)
    got = {r["id"] for r in diffing.touched_nodes(g, spark.createDataFrame(ranges, "file string, start int, end int")).collect()}
    assert got == {k for k, _, f, a, b in nodes for file, c, d in ranges if (f == file or f.endswith("/" + file)) and a <= d and c <= b}


def test_a_diff_over_many_partitions(spark, tmp_path):
    rng = random.Random(9)
    lines, want, file = [], [], None
    for k in range(4000):
        if rng.random() < 0.01:
            file = rng.choice([None, f"src/f{k}.rs"])
            lines.append(f"+++ b/{file}" if file else "+++ /dev/null")
        elif rng.random() < 0.5:
            lines.append(f"@@ -1 +{k + 1},{k % 3} @@ fn")
            if file and k % 3:
                want.append((file, k + 1, k + k % 3))
        else:
            lines.append("+some text")
    frame = spark.createDataFrame([(1, k, line) for k, line in enumerate(lines)] + [(2, 0, "@@ -1 +5 @@"), (2, 1, "+++ b/z.rs"), (2, 2, "@@ -1 +5 @@")], "diff_id int, at int, line string").repartition(7)
    got = parse_diff_lines(frame, ["at"]).collect()
    assert sorted(tuple(r)[1:] for r in got if r["diff_id"] == 1) == sorted(want) and [tuple(r) for r in got if r["diff_id"] == 2] == [(2, "z.rs", 5, 5)]
    whole = spark.createDataFrame([(1, "\n".join(lines))], "diff_id int, text string")
    assert sorted(tuple(r)[1:] for r in parse_diff(whole).collect()) == sorted(want)
    (tmp_path / "big.diff").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        read = read_diffs(spark, str(tmp_path / "big.diff"))
        assert read.rdd.getNumPartitions() > 3
        assert sorted(tuple(r)[1:] for r in parse_diff_lines(read, ["block", "at"]).collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_store_switches_versions_at_once(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    make = lambda n: mods(spark, [f"c::m{k}" for k in range(n)], [("c::m0", "c::m1")])
    assert store.update({"a": "k1", "b": "k1"}, lambda label: make(2)) == ["a", "b"]
    assert store.update({"a": "k1", "b": "k2"}, lambda label: make(3)) == ["b"]
    store.write_version(make(5), "a")  # broken off before it was published
    assert (store.load("a").nodes.count(), store.load("b").nodes.count()) == (2, 3)
    assert {k: v["key"] for k, v in store.current().items()} == {"a": "k1", "b": "k2"}
    both = store.united(["a", "b"])
    assert {(r["label"], r["count"]) for r in both.nodes.groupBy("label").count().collect()} == {("a", 2), ("b", 3)} and both.edges.count() == 2
    with pytest.raises(GraphError):
        store.load("c")
    with pytest.raises(GraphError):
        store.united([])
    with pytest.raises(GraphError):
        store.save(make(2), "a/b", "k")


def test_crate_keys(spark):
    files = {"Cargo.toml": "[workspace]", "a/Cargo.toml": "[package]", "a/src/lib.rs": "fn x", "a/src/deep/.rs": "no stem", "b/Cargo.toml": "[package]", "b/src/lib.rs": "fn x", "b/inner/Cargo.toml": "i", "b/inner/x.rs": "i", "build.rs": "r", "stray.txt": "t"}
    keys = lambda f, **more: dict(map(tuple, crate_keys(spark.createDataFrame([(k, v.encode()) for k, v in f.items()], "path string, content binary"), **more).collect()))
    first = keys(files)
    assert set(first) == {"", "a", "b", "b/inner"} and first["a"] == first["b"]
    changed = lambda f, **more: {d for d, k in keys(f, **more).items() if first[d] != k}
    assert changed(files | {"b/inner/x.rs": "new"}) == {"b/inner"}
    assert changed(files | {"a/Cargo.toml": "[package] x"}) == {"a"} and changed(files | {"build.rs": "new"}) == {""}
    assert changed(files | {"stray.txt": "new", "a/src/deep/.rs": "new"}) == set()
    assert changed(files, lock="l") == changed(files, toolchain="t") == set(first) and keys(files, lock="x") != keys(files, toolchain="x")


def test_folds(spark):
    deps = spark.createDataFrame([("c::a::x", "c::b", 2), ("c::a::y", "c::b::z", 3), ("c::a::x", "c::a::y", 5), ("d", "c::a", 1)], "src string, dst string, weight long")
    assert {tuple(r) for r in folded(deps, 2).collect()} == {("c::a", "c::b", 5), ("d", "c::a", 1)}
    assert {tuple(r) for r in folded(deps, 1).collect()} == {("d", "c", 1)}
    order = ["d", "c", "c::a::x", "c::b", "c::a", "c::a::y", "c::b::z"]
    structure = SimpleNamespace(order=spark.createDataFrame(list(enumerate(order)), "ordinal long, path string"), dependencies=deps)
    closed = spark.createDataFrame([("c::a",), ("c::a::y",)], "path string")
    # rows: d, c, c::a (with x and y), c::b, c::b::z
    assert {tuple(r) for r in folded_matrix(structure, closed).collect()} == {(2, 3, 2), (2, 4, 3), (0, 2, 1)}
