"""URL filters by one bit-parallel automaton that runs all glob rules over each URL at once.

Rules are globs over a URL's canonical form, host then path: `*` stands for any run of characters
but "/", `**` for any run at all, `?` for one character that is not "/"; anything else for itself,
and the whole form must match. All globs are packed into one bit vector of 64-bit words, a bit for each
character of each glob and one for its start (Shift-And). One step over a byte is
``D = ((D << 1) & take[byte]) | (D & stay[byte])`` where `take` holds the bits that the byte may
enter and `stay` the bits on a star. numpy steps all URLs of a batch together, longest first, so
the cost is the bytes of the longest URL times the words of the vector for each row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import text_buffer

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits its host and all its subdomains, where the URL's path starts with `path`."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        return f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"


#: The rules of the op10 contract.
RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
#: Hosts and paths that are blocked where no rule fits.
BLOCK_GLOBS = ("*cheap-pills.*/**", "*adult-*/**", "*casino*/**", "*.xxx/**", "*/porn/**", "*/**/porn/**", "*/**.exe")


class GlobAutomaton:
    """All globs as one Shift-And bit vector."""

    def __init__(self, globs: Sequence[str]):
        places: list[tuple[int | None, str]] = []  # for each bit: the byte that enters it (None: start; -1: any but "/"), and its star
        self.final: list[int] = []
        starts = []
        for glob in globs:
            starts.append(len(places))
            places.append((None, ""))
            raw, at = glob.encode(), 0
            while at < len(raw):
                if raw[at : at + 2] == b"**":
                    places[-1] = (places[-1][0], "**")
                    at += 2
                elif raw[at : at + 1] == b"*":
                    places[-1] = (places[-1][0], places[-1][1] or "*")
                    at += 1
                else:
                    places.append((-1 if raw[at : at + 1] == b"?" else raw[at], ""))
                    at += 1
            self.final.append(len(places) - 1)
        self.words = max(1, -(-len(places) // 64))
        self.take = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for s in starts:
            self.start[s // 64] |= np.uint64(1 << (s % 64))
        for k, (byte, star) in enumerate(places):
            bit, word = np.uint64(1 << (k % 64)), k // 64
            if byte == -1:
                self.take[:, word] |= bit
                self.take[47, word] &= ~bit
            elif byte is not None:
                self.take[byte, word] |= bit
            if star:
                self.stay[:, word] |= bit
            if star == "*":
                self.stay[47, word] &= ~bit

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of booleans for each text: which globs match it."""
        size = np.diff(offsets)
        by = np.argsort(-size, kind="stable")
        state = np.tile(self.start, (len(size), 1))
        start, length = offsets[:-1][by], size[by]
        active = len(by)
        for at in range(int(length[0]) if len(length) else 0):
            while length[active - 1] <= at:
                active -= 1
            byte = data[start[:active] + at]
            now = state[:active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.take[byte]) | (now & self.stay[byte])
        out = np.empty((len(size), len(self.final)), bool)
        for k, bit in enumerate(self.final):
            out[by, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0
        return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Canonical host and path of a URL: both empty for null or without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, *, rules: Sequence[HostRule] = RULES, block: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """Judge each URL.

    pages: page_id, url (other columns are ignored). The longest rule that fits decides (of equally
    long ones the first); where none fits, the URL is blocked if a glob of `block` matches its host
    and path, else allowed. Returns page_id, host, path, rule (its host and path, else null), glob
    (the first that matches, else null) and verdict ("allow" or "block").

    Null URL or one without "://": host and path are empty, no rule fits, the verdict is allow.
    Repeated rows come back each; null page_id is kept. URLs of any length are read whole.
    Empty input: empty output.
    """
    rules, block = tuple(rules), tuple(block)
    automaton = GlobAutomaton([g for r in rules for g in r.globs()] + list(block))
    order = sorted(range(len(rules)), key=lambda k: -len(rules[k].name))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(3))
            hit = automaton.match(data, offsets)
            n = batch.num_rows
            rule = np.full(n, -1)
            for k in reversed(order):
                rule[hit[:, 2 * k] | hit[:, 2 * k + 1]] = k
            globs = hit[:, 2 * len(rules) :]
            glob = np.where(globs.any(axis=1), globs.argmax(axis=1), -1) if block else np.full(n, -1)
            verdict = np.where(rule >= 0, np.array([r.action for r in rules] + ["allow"])[rule], np.where(glob >= 0, "block", "allow"))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in range(3)),
                    pa.array([rules[k].name if k >= 0 else None for k in rule], pa.string()),
                    pa.array([block[k] if k >= 0 else None for k in glob], pa.string()),
                    pa.array(verdict.tolist(), pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "glob", "verdict"],
            )

    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("form", F.concat("host", "path"))
    return parts.mapInArrow(task, "page_id long, host string, path string, rule string, glob string, verdict string")
