"""Package metadata and workspace members, from their captured listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.functions import wildcard_matches
from undertow.schema import GraphError

#: Target kinds that make a package a library (fixed values).
LIBRARY_KINDS = ("lib", "rlib", "dylib", "cdylib", "staticlib", "proc-macro")


_METADATA = "packages array<struct<name string, manifest_path string, targets array<struct<name string, kind array<string>>>>>"


def read_metadata(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """(name, manifest_path, targets) of each package in captured package metadata (JSON; with `lines` one document on each line)."""
    documents = spark.read.schema(_METADATA).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return documents.select(F.explode("packages").alias("p")).select("p.*")


def chosen_target(targets: Column) -> Column:
    """targets: array<struct<name, kind: array>>. "lib" if any is a library, "bin:<name>" if exactly one is a binary, else null."""
    library = F.exists(targets, lambda t: F.exists(t["kind"], lambda k: k.isin(*LIBRARY_KINDS)))
    binaries = F.filter(targets, lambda t: F.array_contains(t["kind"], "bin"))
    return F.when(library, "lib").when(F.size(binaries) == 1, F.concat(F.lit("bin:"), F.get(binaries, F.lit(0))["name"]))


def find_package(packages: DataFrame, *, name: str | None = None, manifest: str | None = None) -> DataFrame:
    """The first package by name or by manifest path, with its target."""
    if (name is None) == (manifest is None):
        raise GraphError("give a name or a manifest path")
    wanted = F.col("name") == name if name is not None else F.col("manifest_path") == manifest
    return packages.filter(wanted).orderBy("name", "manifest_path").limit(1).withColumn("target", chosen_target(F.col("targets")))


def root_nature(manifest: dict) -> str:
    """"package" or "workspace" of a parsed manifest; a package wins."""
    for key in ("package", "workspace"):
        if key in manifest:
            return key
    raise GraphError("the manifest declares neither a package nor a workspace")


def root_natures(manifests: DataFrame) -> DataFrame:
    """(root, text) of many manifests to (root, nature): "package", "workspace", or null with neither; a package wins.

    A table counts by its header or by a dotted key at the top of the file.
    """
    declares = lambda t: F.col("text").rlike(rf"(?m)^[ \t]*\[[ \t]*{t}[ \t]*[.\]]") | F.regexp_extract("text", r"\A([^\[]*)", 1).rlike(rf"(?m)^[ \t]*{t}[ \t]*[.=]")
    return manifests.select("root", F.when(declares("package"), "package").when(declares("workspace"), "workspace").alias("nature"))


def _under(dirs: DataFrame, pattern: str) -> DataFrame:
    wanted = [p for p in pattern.split("/") if p not in ("", ".")]
    parts = F.split("dir", "/")
    fits = [wildcard_matches(F.get(parts, F.lit(i)), p) for i, p in enumerate(wanted)]
    return dirs.filter(reduce(lambda a, b: a & b, fits, F.size(parts) == len(wanted)))


def workspace_members(dirs: DataFrame, members: list[str], excludes: list[str]) -> DataFrame:
    """(name, dir) of the packages that the member patterns name and the excludes do not.

    dirs: (dir, name), name null for a folder without a package of its own. A star stands for any
    part of one path component.
    """
    if not members:
        return dirs.limit(0).select("name", "dir")
    found = reduce(DataFrame.union, [_under(dirs, p) for p in members]).dropDuplicates(["dir"])
    for p in excludes:
        found = found.join(_under(dirs, p).select("dir"), "dir", "left_anti")
    return found.filter("name is not null").select("name", "dir")
