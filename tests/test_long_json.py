"""A long document in blocks of any size gives what the reader of whole documents gives."""

import json
import random

import pytest

from undertow.schema import InvalidGraph
from undertow.sources.json_graph import read_graph
from undertow.sources.long_json import _inside, document_objects, document_parts, read_long_graph


def document(seed=3, n=40):
    rng = random.Random(seed)
    odd = ['a"b', "c\\", '\\"', "}{][", "é日\U0001f600", '","nodes":[{', "\\\\\\"]
    node = lambda i: {"id": i, "path": f"x::{rng.choice(odd)}{i}", "name": rng.choice(odd) * rng.randint(1, 9), "kind": "fn", "visibility": "pub", "cfg": {"all": [rng.choice(odd), {"k": [1, {}]}]}, "position": {"file": rng.choice(odd), "start_line": i, "end_line": i + 1}}
    edge = lambda i: {"id_from": rng.randrange(n), "id_to": rng.randrange(n), "from": rng.choice(odd), "relation": "uses", "uses_kind": rng.choice(["reference", "import", None])}
    return {"note": {"nodes": [{"deep": [{}]}]}, "crate": 'c"\\', "other": [{"id": 1}, [{}]], "nodes": [node(i) for i in range(n)], "empty": [], "edges": [edge(i) for i in range(3 * n)], "end": "nodes"}


@pytest.mark.parametrize(("block", "indent", "n"), [(61, None, 4), (509, 1, 12), (4096, None, 40)])
def test_blocks_of_any_size(spark, tmp_path, block, indent, n):
    (tmp_path / "a b.json").write_text(json.dumps(document(n=n), indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    whole, cut = read_graph(spark, str(tmp_path)), read_long_graph(spark, str(tmp_path), block=block)
    assert cut.name == whole.name == 'c"\\'
    for a, b in ((whole.nodes, cut.nodes), (whole.edges, cut.edges)):
        assert a.columns == b.columns
        rows = sorted(map(repr, a.collect()))
        assert rows and rows == sorted(map(repr, b.collect()))


def test_places_follow_the_document_over_many_tasks(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps(document(n=200)))
    parts = document_parts(spark, str(path), 1024)
    found = document_objects(parts, "edges")
    assert found.rdd.getNumPartitions() > 40
    assert [json.loads(r["text"]) for r in found.orderBy("seq").collect()] == document(n=200)["edges"]


def test_an_object_longer_than_many_blocks(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text('{"nodes":[{"id":1,"path":"a","name":"' + "\\\\" * 400 + '","kind":"fn","visibility":"pub"}],"edges":[]}')
    graph = read_long_graph(spark, str(path), block=16, label="l")
    assert [(r["name"], r["label"]) for r in graph.nodes.collect()] == [("\\" * 400, "l")]
    assert graph.edges.count() == 0 and "label" in graph.edges.columns


@pytest.mark.parametrize("text", ['{"nodes":[{"id":1', '{"nodes":[]', '{"crate":"x'])
def test_incomplete_documents(spark, tmp_path, text):
    (tmp_path / "g.json").write_text(text)
    with pytest.raises(InvalidGraph):
        read_long_graph(spark, str(tmp_path), block=8)


def test_empty_files_and_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text("{}")
    graph = read_long_graph(spark, str(tmp_path))
    assert graph.nodes.count() == graph.edges.count() == 0


def test_escapes_over_the_start_of_a_block():
    data = b'"a\\\\\\"b" "\\\\"'
    quote, _ = _inside(data, False, False)
    for cut in range(1, len(data)):
        before = data[:cut]
        escaped = (len(before) - len(before.rstrip(b"\\"))) % 2 == 1
        assert (_inside(data[cut:], escaped, False)[0] == quote[cut:]).all()


@pytest.mark.parametrize(("size", "block"), [(7, 61), (997, 509), (5000, 100)])
def test_a_document_in_pieces(spark, tmp_path, size, block):
    data = json.dumps(document(n=8), ensure_ascii=False).encode()
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "g.json").write_bytes(data)
    (tmp_path / "cut").mkdir()
    for k in range(0, len(data), size):
        (tmp_path / "cut" / f"part-{k:05d}").write_bytes(data[k : k + size])
    (tmp_path / "cut" / "part-00000-empty").write_bytes(b"")
    whole, cut = read_graph(spark, str(tmp_path / "whole")), read_long_graph(spark, str(tmp_path / "cut"), block=block, in_pieces=True)
    assert cut.name == whole.name
    for a, b in ((whole.nodes, cut.nodes), (whole.edges, cut.edges)):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_blocks_share_tasks(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps(document(n=200)))
    parts = document_parts(spark, str(path), 64)
    assert parts.select("start").distinct().count() > 512
    found = document_objects(parts, "edges")
    assert found.rdd.getNumPartitions() <= 256
    assert [json.loads(r["text"]) for r in found.orderBy("seq").collect()] == document(n=200)["edges"]
