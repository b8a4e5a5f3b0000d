"""Graphs kept as Parquet, one immutable version for each crate and key, so that a changed input rewrites only itself."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.graph import Graph
from undertow.schema import GraphError


def content_key(sections: Iterable[tuple[str, bytes]]) -> str:
    """SHA-256 over named sections, each with its length, so that no two lists of sections run together."""
    digest = hashlib.sha256()
    for name, content in sections:
        digest.update(f"{name}:{len(content)}:".encode())
        digest.update(content)
    return digest.hexdigest()


def source_keys(spark: SparkSession, folder: str, pattern: str = "*.rs") -> DataFrame:
    """(dir, key): one digest for each folder of source files, over their names in the folder and contents in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    files = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.struct(F.substring_index("path", "/", -1).alias("path"), F.sha2("content", 256).alias("digest")).alias("f"))
    return files.groupBy("dir").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda f: F.concat_ws(":", f["path"], f["digest"])), "\n"), 256).alias("key"))


def crate_keys(files: DataFrame, *, lock: str = "", toolchain: str = "") -> DataFrame:
    """(dir, key) of each crate: SHA-256 over its sources, its manifest, the lock file and the toolchain.

    files: (path, content), path relative to the root. A crate is a folder with a Cargo.toml; an .rs
    file belongs to the nearest crate above it, and to none without one. Each section goes in with
    its length; an absent lock or toolchain is an empty section. Contents are reduced to digests
    before they are put in order, so a row holds some bytes for each file of a crate.
    """
    name = F.substring_index("path", "/", -1)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    files = files.select("path", name.alias("name"), folder.alias("dir"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    crates = files.filter("name = 'Cargo.toml'").select(F.col("dir").alias("crate"), F.col("digest").alias("manifest"))
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    sources = files.filter(F.col("name").rlike(r"[^/]\.rs$")).select("path", "digest", F.explode(above).alias("crate")).join(crates.select("crate"), "crate", "left_semi")
    nearest = sources.groupBy("path", "digest").agg(F.max_by("crate", F.length("crate")).alias("crate"))
    inside = F.when(F.col("crate") == "", F.col("path")).otherwise(F.substr(F.col("path"), F.length("crate") + 2))
    lines = nearest.groupBy("crate").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(inside.alias("path"), "digest"))), lambda f: F.concat_ws(":", f["path"], f["digest"])), "\n").alias("sources"))
    section = lambda title, text: F.concat(F.lit(f"{title}:"), F.octet_length(text).cast("string"), F.lit(":"), text)
    texts = {"sources": F.coalesce("sources", F.lit("")), "manifest": F.col("manifest"), "lock": F.lit(lock), "toolchain": F.lit(toolchain)}
    return crates.join(lines, "crate", "left").select(F.col("crate").alias("dir"), F.sha2(F.concat(*[section(*x) for x in texts.items()]).cast("binary"), 256).alias("key"))


def save_graph(graph: Graph, folder: str, key: str) -> None:
    """Replace the graph stored under key. Readers may see new nodes with old edges meanwhile: see GraphStore."""
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes/graph_key={key}")
    graph.edges.write.mode("overwrite").parquet(f"{folder}/edges/graph_key={key}")


def load_graph(spark: SparkSession, folder: str, key: str) -> Graph:
    return Graph.of(spark.read.parquet(f"{folder}/nodes/graph_key={key}"), spark.read.parquet(f"{folder}/edges/graph_key={key}"))


@dataclass(frozen=True)
class GraphStore:
    """Graphs by label, each in immutable versions, in a folder that all executors share.

    A version is a folder of nodes and one of edges under a name of its own. It becomes the graph of
    its label when a manifest with the next number appears, which names key and folder of the version:
    the manifest is written aside and renamed, so it is there whole or not at all, and nodes and
    edges change together. What breaks off before leaves the old graph. One writer at a time for a label.
    """

    spark: SparkSession
    folder: str

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> dict[str, tuple[int, str]]:
        """The last manifest of each label: (number, text)."""
        pattern, fs = self._path("manifests/label=*/*.json")
        last: dict[str, tuple[int, str]] = {}
        for f in fs.globStatus(pattern) or ():
            label, number = f.getPath().getParent().getName().removeprefix("label="), int(f.getPath().getName().removesuffix(".json"))
            if number > last.get(label, (0, ""))[0]:
                last[label] = number, f.getPath().toString()
        return last

    def current(self) -> dict[str, dict[str, str]]:
        """{label: {"key", "version"}} of what is published; as many small files as labels are read."""
        found = {}
        for label, (_, name) in self._manifests().items():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
            try:
                found[label] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return found

    def write_version(self, graph: Graph, label: str) -> str:
        """Write nodes and edges under a new name that nobody reads yet; returns the name."""
        if not label or "/" in label or "=" in label:
            raise GraphError("a label is a plain file name")
        version = f"versions/label={label}/{uuid.uuid4().hex}"
        graph.nodes.write.parquet(f"{self.folder}/{version}/nodes")
        graph.edges.write.parquet(f"{self.folder}/{version}/edges")
        return version

    def publish(self, label: str, key: str, version: str) -> None:
        """From now on, `version` is the graph of the label."""
        number = self._manifests().get(label, (0, ""))[0] + 1
        aside, fs = self._path(f"manifests/label={label}/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(json.dumps({"key": key, "version": version}).encode())
        stream.close()
        if not fs.rename(aside, self._path(f"manifests/label={label}/{number}.json")[0]):
            raise GraphError(f"another writer published {label}")

    def save(self, graph: Graph, label: str, key: str) -> None:
        self.publish(label, key, self.write_version(graph, label))

    def load(self, label: str) -> Graph:
        found = self.current().get(label)
        if found is None:
            raise GraphError(f"no graph is stored for {label}")
        return Graph.of(*(self.spark.read.parquet(f"{self.folder}/{found['version']}/{part}") for part in ("nodes", "edges")), label)

    def update(self, keys: dict[str, str], make: Callable[[str], Graph]) -> list[str]:
        """Make and store the graphs of the labels whose key is not the stored one; returns those labels."""
        stored = self.current()
        stale = sorted(label for label, key in keys.items() if stored.get(label, {}).get("key") != key)
        for label in stale:
            self.save(make(label), label, keys[label])
        return stale

    def united(self, labels: Iterable[str]) -> Graph:
        """The stored graphs of some labels as one with a label column, as the union of a workspace wants it."""
        graphs = [(label, self.load(label)) for label in labels]
        if not graphs:
            raise GraphError("no graph of the workspace is stored")
        marked = lambda part: reduce(DataFrame.unionByName, [getattr(g, part).withColumn("label", F.lit(label)) for label, g in graphs])
        return Graph(marked("nodes"), marked("edges"), "workspace")
