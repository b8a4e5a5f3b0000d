"""Checks of arguments, and errors as messages and exit codes."""

import pytest

from undertow.plans.requests import BadRequest, ExtractorError, Source, choose_scope, choose_source, choose_target, choose_uses_mode, explain, label_of
from undertow.schema import GraphError, InvalidGraph, TargetNotFound, Undecided, UntypedUses


def test_exactly_one_of_two():
    assert choose_source(document="g.json").document == "g.json" and choose_source(package="p").package == "p"
    assert choose_target(path="a::b").asked == "a::b" and choose_target(node_id=0).asked == "id=0"
    for call in (choose_source, lambda: choose_source("g.json", "p"), choose_target, lambda: choose_target("a", 1)):
        with pytest.raises(BadRequest):
            call()
    assert (choose_scope(True), choose_scope(False), choose_uses_mode(True), choose_uses_mode(False)) == ("own_code", "full", "reference_only", "all")


def test_an_id_is_named_beside_its_path():
    assert choose_target(path="a").resolved("a") == {"target": "a"}
    assert choose_target(node_id=7).resolved("a::b") == {"requested": "id=7", "resolved": "a::b"}


@pytest.mark.parametrize(("source", "label"), [(Source(package="my-crate"), "my-crate"), (Source(document="/x/egui.v1.json"), "egui.v1"), (Source(document=""), "structure"), (Source(), "structure")])
def test_label(source, label):
    assert label_of(source) == label


@pytest.mark.parametrize(
    ("error", "code", "message"),
    [
        (BadRequest("one of them"), 2, "one of them"),
        (TargetNotFound("a::<T>::b"), 1, "no node a::b in the graph"),
        (InvalidGraph("duplicate id: 3"), 1, "the graph is not valid: duplicate id: 3"),
        (UntypedUses("the edges have no kind"), 1, "only references were asked for, but the edges have no kind"),
        (Undecided("x"), 1, "paths that stand for several nodes could not be settled: x"),
        (GraphError("other"), 1, "other"),
        (ExtractorError("missing"), 1, "the extractor was not found"),
        (ExtractorError("status", " boom\n", 101), 1, "the extractor ended with status 101: boom"),
        (FileNotFoundError(2, "No such file", "g.json"), 1, "a.json could not be read: no such file"),
        (PermissionError(13, "Permission denied"), 1, "a.json could not be read: Permission denied"),
    ],
)
def test_messages(error, code, message):
    assert explain(error, asked="a::b", file="a.json") == (code, message)


def test_unknown_errors_are_not_hidden():
    with pytest.raises(KeyError):
        explain(KeyError("x"))
    with pytest.raises(ValueError):
        ExtractorError("odd")
