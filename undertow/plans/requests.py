"""What is asked of an analysis: checks of its arguments, and errors as messages and exit codes."""

from __future__ import annotations

import os
from dataclasses import dataclass

from undertow.render import fill_template
from undertow.schema import GraphError, InvalidGraph, TargetNotFound, Undecided, UntypedUses


class BadRequest(GraphError):
    """Arguments that do not go together."""


class ExtractorError(GraphError):
    """Captured output of an extractor that cannot be used. kind: missing, failed, status, encoding or target."""

    def __init__(self, kind: str, detail: str = "", code: int | None = None):
        if kind not in EXTRACTOR_MESSAGES:
            raise ValueError(f"unknown kind of extractor error: {kind}")
        super().__init__(fill_template(EXTRACTOR_MESSAGES[kind], {"detail": detail.strip(), "code": code}))
        self.kind, self.code = kind, code


EXTRACTOR_MESSAGES = {
    "missing": "the extractor was not found",
    "failed": "the extractor could not be run: {detail}",
    "status": "the extractor ended with status {code}: {detail}",
    "encoding": "the extractor's output is no UTF-8: {detail}",
    "target": "no target could be chosen: {detail}",
}
#: From the narrowest error to the widest; {detail} is the error's own text, {asked} what was asked for.
MESSAGES: tuple[tuple[type[Exception], str], ...] = (
    (BadRequest, "{detail}"),
    (TargetNotFound, "no node {asked} in the graph"),
    (InvalidGraph, "the graph is not valid: {detail}"),
    (UntypedUses, "only references were asked for, but {detail}"),
    (Undecided, "paths that stand for several nodes could not be settled: {detail}"),
    (ExtractorError, "{detail}"),
    (GraphError, "{detail}"),
    (FileNotFoundError, "{file} could not be read: no such file"),
    (OSError, "{file} could not be read: {detail}"),
)
#: Exit codes (fixed values): an analysis that failed, and arguments that were refused.
FAILED, REFUSED = 1, 2


@dataclass(frozen=True)
class Source:
    """Exactly one of a graph document and a package."""

    document: str | None = None
    package: str | None = None


@dataclass(frozen=True)
class Target:
    """Exactly one of a path and an id."""

    path: str | None = None
    node_id: int | None = None

    @property
    def asked(self) -> str:
        """The target in the words of whoever asked."""
        return self.path if self.path is not None else f"id={self.node_id}"

    def resolved(self, path: str) -> dict[str, str]:
        """How an answer names its target: a path as it is, an id beside the path that it stands for."""
        return {"target": path} if self.path is not None else {"requested": self.asked, "resolved": path}


def choose_source(document: str | None = None, package: str | None = None) -> Source:
    if (document is None) == (package is None):
        raise BadRequest("give a graph document or a package, one of them")
    return Source(document, package)


def choose_target(path: str | None = None, node_id: int | None = None) -> Target:
    if (path is None) == (node_id is None):
        raise BadRequest("give the path or the id of a target, one of them")
    return Target(path, node_id)


def choose_scope(own_code: bool) -> str:
    return "own_code" if own_code else "full"


def choose_uses_mode(references_only: bool) -> str:
    return "reference_only" if references_only else "all"


def label_of(source: Source) -> str:
    """What a view of a source is called: the package, else the document's name without its ending."""
    if source.package is not None:
        return source.package
    stem = os.path.splitext(os.path.basename(source.document or ""))[0]
    return stem or "structure"


def explain(error: Exception, asked: str = "", file: str = "") -> tuple[int, str]:
    """(exit code, message) of an error; asked is what the user called the target, whatever it is called inside."""
    for kind, template in MESSAGES:
        if isinstance(error, kind):
            detail = getattr(error, "strerror", None) or str(error)
            message = fill_template(template, {"detail": detail, "asked": asked or str(error), "file": file or getattr(error, "filename", None) or "the file"})
            return (REFUSED if kind is BadRequest else FAILED), message
    raise error
