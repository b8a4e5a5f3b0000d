"""Scalar functions over paths, files and kinds, as column expressions."""

from undertow.functions.paths import (
    base_kind,
    basename,
    crate_of,
    file_matches,
    insert_trait,
    line_count,
    member_name,
    normalized_key,
    path_ends,
    ranges_overlap,
    short_name,
    wildcard_matches,
)

__all__ = ["base_kind", "basename", "crate_of", "file_matches", "insert_trait", "line_count", "member_name", "normalized_key", "path_ends", "ranges_overlap", "short_name", "wildcard_matches"]
