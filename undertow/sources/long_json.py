"""One very large graph document, read by many tasks.

A file is dealt out in blocks of bytes. Whether a block starts inside a string, and how deep, follows
from sums over the blocks before it: the first scan counts quotes and steps of depth for either case.
The second finds the keys of the document in each block, the third gives the objects that start in
it, and reads on over its end for the last one. Only these sums, one row for a block and one for a
key, meet in windows; the objects themselves are parsed where they are read. A document may lie in
pieces, as many tasks write one: then the files of a folder count as one, in the order of their names.
Spark lists the files; tasks open them through pyarrow's file systems, so that every executor must reach them by these.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.graph import Graph
from undertow.runtime import materialize
from undertow.schema import DOCUMENT_SCHEMA, InvalidGraph
from undertow.sources.json_graph import checked, graph_edges, graph_nodes

BLOCK = 16 << 20
#: Blocks are dealt over this many tasks or fewer; over more only where a task would have more than _SHARE bytes to read.
_TASKS, _SHARE = 256, 256 << 20
_QUOTE, _SLASH, _BRACE = 34, 92, 123
_STEPS = np.zeros(256, np.int8)
_STEPS[list(b"{[")], _STEPS[list(b"}]")] = 1, -1
#: A string; where it is a key, its colon and the string after it.
_STRING = re.compile(rb'("[^"\\]*+(?:\\.[^"\\]*+)*+")\s*+(:\s*+("[^"\\]*+(?:\\.[^"\\]*+)*+")?)?', re.S)


Pieces = list[tuple[str, int]]


def _opened(file: str):
    local = re.match(r"(?:file:)?(/.*)", file)
    system, path = (fs.LocalFileSystem(), re.sub("^/+", "/", unquote(local[1]))) if local else fs.FileSystem.from_uri(file)
    return system.open_input_file(path)


class _Bytes:
    """The bytes of one document from a place on; `more` doubles what is held.

    pieces: the files of the document with their sizes; without any, it is the file of that name.
    """

    def __init__(self, file: str, start: int, size: int, pieces: Pieces):
        self._files: dict[int, object] = {}
        self._pieces = pieces or [(file, (self._files.setdefault(0, _opened(file))).size())]
        self._ends = list(accumulate(n for _, n in self._pieces))
        self._start = start
        self.held = self._read(start, size)
        self.block = len(self.held)

    def _read(self, at: int, n: int) -> bytes:
        found = []
        k = bisect_right(self._ends, at)
        while n > 0 and k < len(self._ends):
            if k not in self._files:
                self._files[k] = _opened(self._pieces[k][0])
            source, end = self._files[k], self._ends[k]
            source.seek(at - end + self._pieces[k][1])
            found.append(source.read(min(n, end - at)))
            at, n, k = at + len(found[-1]), n - len(found[-1]), k + 1
        return b"".join(found)

    def escaped(self) -> bool:
        """Whether a run of backslashes before the start escapes the first byte."""
        n = 0
        while n < self._start and self._read(self._start - n - 1, 1) == b"\\":
            n += 1
        return n % 2 == 1

    def more(self) -> bool:
        new = self._read(self._start + len(self.held), max(len(self.held), 1 << 16))
        self.held += new
        return bool(new)

    def close(self) -> None:
        for source in self._files.values():
            source.close()


def _inside(data: bytes, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(quotes that open or close a string, places from an opening quote to before the closing one)."""
    b = np.frombuffer(data, np.uint8)
    quote = b == _QUOTE
    slash = np.flatnonzero(b == _SLASH)
    if slash.size:
        first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
        starts, ends = slash[first], np.append(slash[first[1:] - 1], slash[-1]) + 1
        odd = (ends - starts - (escaped & (starts == 0))) % 2 == 1
        quote[ends[odd & (ends < len(b))]] = False
    if escaped and len(b):
        quote[0] = False
    return quote, ((np.cumsum(quote, dtype=np.uint8) + inside) & 1).astype(bool)


def _brackets(data: bytes, within: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, step, depth after it) of the brackets outside strings."""
    steps = _STEPS[np.frombuffer(data, np.uint8)]
    steps[within] = 0
    at = np.flatnonzero(steps)
    return at, steps[at], depth + np.cumsum(steps[at], dtype=np.int64)


def _counted(pieces: Pieces):
    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks:
            rows = []
            for x in frame.itertuples():
                source = _Bytes(x.file, x.start, x.size, pieces)
                quote, within = _inside(source.held, source.escaped(), False)
                steps = _STEPS[np.frombuffer(source.held, np.uint8)]
                inner = int(steps[within].sum())
                rows.append((x.file, x.start, x.size, int(quote.sum()), int(steps.sum()) - inner, inner))
                source.close()
            yield pd.DataFrame(rows, columns=["file", "start", "size", "quotes", "outer", "inner"])

    return run


def _keyed(pieces: Pieces):
    """Of each block the keys of the document, with a string value if there is one, and how many objects follow each."""

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks:
            rows = []
            for x in frame.itertuples():
                source = _Bytes(x.file, x.start, x.size, pieces)
                quote, within = _inside(source.held, source.escaped(), x.inside)
                at, step, depth = _brackets(source.held, within, x.depth)
                opens = np.flatnonzero(quote & within)
                levels = np.concatenate(([x.depth], depth))[np.searchsorted(at, opens)]
                keys = [(0, None, None)]
                for place in opens[levels == 1].tolist():
                    while True:
                        found = _STRING.match(source.held, place)
                        if (found and found.end() < len(source.held)) or not source.more():
                            break
                    if found and found[2]:
                        keys.append((place, json.loads(found[1]), found[3] and json.loads(found[3])))
                objects = at[(step == 1) & (depth == 3)]
                objects = objects[np.frombuffer(source.held, np.uint8)[objects] == _BRACE]
                counts = np.bincount(np.searchsorted([k[0] for k in keys], objects, "right") - 1, minlength=len(keys))
                rows += [(x.file, x.start, x.size, x.inside, x.depth, *k, int(n)) for k, n in zip(keys, counts)]
                source.close()
            yield pd.DataFrame(rows, columns=["file", "start", "size", "inside", "depth", "at", "key", "value", "objects"])

    return run


def _cut(wanted: str, pieces: Pieces, batch: int = 8 << 20):
    """The objects that start in each block below the wanted key, with their places in the document."""

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks:
            for x in frame.itertuples():
                parts = sorted((p["at"], p["key"], p["first"]) for p in x.parts)
                source = _Bytes(x.file, x.start, x.size, pieces)
                at, step, depth = _brackets(source.held, _inside(source.held, source.escaped(), x.inside)[1], x.depth)
                opens = np.flatnonzero((step == 1) & (depth == 3))
                opens = opens[np.frombuffer(source.held, np.uint8)[at[opens]] == _BRACE]
                closes = np.flatnonzero((step == -1) & (depth == 2))
                starts = at[opens]
                part = np.searchsorted([p[0] for p in parts], starts, "right") - 1
                # The place of an object: how many of its key stood before the part, and how many before it in the part.
                seq = np.array([p[2] for p in parts])[part] + np.arange(len(part)) - np.searchsorted(part, part)
                ends = np.searchsorted(closes, opens)
                stops = np.append(at[closes] + 1, 0)[ends]  # 0: in a later block
                kept = np.array([p[1] == wanted for p in parts])[part]
                starts, stops, seq = starts[kept], stops[kept], seq[kept]
                if len(stops) and not stops[-1]:
                    stops[-1] = _end_of_object(source, int(starts[-1]))
                shares = np.cumsum(stops - starts) // batch
                for low, high in zip(*(np.searchsorted(shares, np.unique(shares), side) for side in ("left", "right"))):
                    texts = [source.held[a:b].decode() for a, b in zip(starts[low:high].tolist(), stops[low:high].tolist())]
                    yield pd.DataFrame({"file": x.file, "seq": seq[low:high], "text": texts})
                source.close()

    return run


def _end_of_object(source: _Bytes, start: int) -> int:
    """Where the object that starts at a place of what is held ends, which may be in a later block."""
    while True:
        data = source.held[start:]
        at, _, depth = _brackets(data, _inside(data, False, False)[1], 0)
        shut = np.flatnonzero(depth == 0)
        if shut.size:
            return start + int(at[shut[0]]) + 1
        if not source.more():
            raise InvalidGraph("a document ends inside an object")


def document_pieces(spark: SparkSession, path: str) -> Pieces:
    """The files of a folder, in the order of their names, with their sizes: a listing, as Spark itself keeps one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").filter("length > 0")
    return [(r["path"], r["length"]) for r in files.orderBy("path").collect()]


def _dealt(blocks: DataFrame) -> DataFrame:
    """Blocks over tasks that read about as much each, neighbours apart."""
    n = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return blocks.repartition(max(1, min(n["blocks"], max(_TASKS, n["size"] // _SHARE))))


def document_parts(spark: SparkSession, path: str, block: int = BLOCK, pieces: Pieces = ()) -> DataFrame:
    """(file, start, size, inside, depth, at, key, value, objects, first): keys of documents by block, stored once.

    The row of a key counts the objects under it in its block; `first` is how many stood under the same
    key before. A block that goes on under the key of the one before has a row for that. A file
    that is no complete JSON object raises InvalidGraph; an empty one has no rows. With pieces
    (document_pieces) they all are one document, which has the name of the folder.
    """
    if pieces:
        files = spark.createDataFrame([(path, sum(n for _, n in pieces))], "file string, length long")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "length").filter("length > 0")
    blocks = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))).alias("start"))
    blocks = blocks.select("file", "start", F.least(F.lit(block), F.col("length") - F.col("start")).alias("size"))

    counted = _dealt(blocks).mapInPandas(_counted(pieces), "file string, start long, size long, quotes long, outer long, inner long")
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    known = materialize(counted, "json-blocks").withColumn("inside", inside)
    known = known.withColumn("step", F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer")))
    known = materialize(known.withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0))), "json-depths")
    broken = known.groupBy("file").agg(F.sum("quotes").alias("quotes"), F.sum("step").alias("depth")).filter("quotes % 2 = 1 or depth != 0").first()
    if broken:
        raise InvalidGraph(f"a document that is not complete: {broken['file']}")

    keyed = _dealt(known.select("file", "start", "size", "inside", "depth"))
    keyed = keyed.mapInPandas(_keyed(pieces), "file string, start long, size long, inside boolean, depth long, at long, key string, value string, objects long")
    order = W.partitionBy("file").orderBy("start", "at")
    keyed = materialize(keyed, "json-keys").withColumn("key", F.last("key", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    counts = F.sum("objects").over(W.partitionBy("file", "key").orderBy("start", "at").rowsBetween(W.unboundedPreceding, -1))
    return materialize(keyed.withColumn("first", F.coalesce(counts, F.lit(0))), "json-parts")


def document_objects(parts: DataFrame, key: str, pieces: Pieces = ()) -> DataFrame:
    """(file, seq, text): the objects in the array under a key of each document, and their places in it."""
    blocks = parts.groupBy("file", "start", "size", "inside", "depth").agg(F.collect_list(F.struct("at", "key", "first")).alias("parts"), F.max((F.col("key") == key) & (F.col("objects") > 0)).alias("wanted"))
    blocks = blocks.filter("wanted").drop("wanted")
    return _dealt(blocks).mapInPandas(_cut(key, pieces), "file string, seq long, text string")


def read_long_graph(spark: SparkSession, path: str, *, label: str | None = None, block: int = BLOCK, in_pieces: bool = False) -> Graph:
    """The graph of `read_graph` from one document a file, each cut into blocks that are read by tasks of their own.

    The arrays hold objects, which may be longer than a block. Objects that don't fit the schema
    raise an error, as there. With `in_pieces` the files of the folder are one document. The result is
    stored, so that files are parsed once.
    """
    pieces = document_pieces(spark, path) if in_pieces else []
    parts = document_parts(spark, path, block, pieces)
    name = parts.filter("key = 'crate' and value is not null").select("value").first()

    def objects(key: str) -> DataFrame:
        found = document_objects(parts, key, pieces)
        element = DOCUMENT_SCHEMA[key].dataType.elementType
        found = found.select("seq", F.from_json("text", element, {"mode": "FAILFAST"}).alias("x"))
        return found if label is None else found.withColumn("label", F.lit(label))

    labels = [] if label is None else ["label"]
    nodes = graph_nodes(objects("nodes").select(*labels, "x.*"))
    edges = graph_edges(objects("edges").select(*labels, F.col("seq").alias("edge_seq"), F.col("x").alias("e")))
    return checked(Graph.of(nodes, edges, name["value"] if name else "").stored())
