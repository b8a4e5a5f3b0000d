"""Scalar functions over paths, files and kinds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEP = "::"


def crate_of(path: Column) -> Column:
    """First segment of a path."""
    return F.split_part(path, F.lit(_SEP), F.lit(1))


def member_name(path: Column) -> Column:
    """First segment, with dashes as underscores."""
    return F.translate(crate_of(path), "-", "_")


def normalized_key(path: Column) -> Column:
    """The path without its first segment; empty for a root."""
    return F.when(F.contains(path, F.lit(_SEP)), F.substr(path, F.instr(path, _SEP) + len(_SEP))).otherwise(F.lit(""))


def short_name(path: Column, crate: Column) -> Column:
    """The path within its crate; the whole path of the root, or of a path of another crate."""
    inside = F.startswith(path, F.concat(crate, F.lit(_SEP)))
    return F.when(inside, F.substr(path, F.length(crate) + len(_SEP) + 1)).otherwise(path)


def insert_trait(path: Column, trait: Column) -> Column:
    """Put <trait> before the last segment: a::b becomes a::<T>::b, and b becomes <T>::b."""
    cut = F.length(path) - F.length(F.substring_index(path, _SEP, -1))
    return F.concat(F.substr(path, F.lit(1), cut), F.lit("<"), trait, F.lit(">::"), F.substring_index(path, _SEP, -1))


def base_kind(kind: Column) -> Column:
    """Last word of a kind such as "const unsafe fn"."""
    return F.element_at(F.split(kind, " "), -1)


def basename(file: Column) -> Column:
    return F.substring_index(file, "/", -1)


def file_matches(file: Column, changed: Column) -> Column:
    """Whether a changed file is this file, or its end after a "/"."""
    return (file == changed) | F.endswith(file, F.concat(F.lit("/"), changed))


def path_ends(file: Column) -> Column:
    """The file itself and what stands behind each "/": all changed files that this file matches."""
    parts = F.split(file, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def ranges_overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the inclusive ranges [a, b] and [c, d] meet."""
    return (a <= d) & (c <= b)


def line_count(text: Column) -> Column:
    """Newlines, and one more for a last line without one."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return breaks + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def wildcard_matches(name: Column, pattern: str) -> Column:
    """One path component against a pattern with at most one star."""
    if "*" not in pattern:
        return name == pattern
    before, after = pattern.split("*", 1)
    return F.startswith(name, F.lit(before)) & F.endswith(name, F.lit(after)) & (F.length(name) >= len(before) + len(after))
