"""Results as JSON or text. Only results that somebody reads are rendered; they reach the driver row by row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions import basename
from undertow.operators.compare import items_with, top_weight_deltas, unpaired_by_crate
from undertow.operators.diffing import by_crate, touched_by_crate
from undertow.operators.numbering import numbered
from undertow.operators.reach import combined


def fill_template(template: str, values: dict[str, object]) -> str:
    """Replace {key} by its value; unknown keys stay as they are."""
    for key, value in values.items():
        template = template.replace("{" + key + "}", str(value))
    return template


def _dump(document: dict) -> str:
    return json.dumps(document, ensure_ascii=False, sort_keys=True, indent=2)


def radius_json(about: DataFrame, found: DataFrame, *, requested: str | None = None) -> str:
    """One document: the target, its class and degrees, and both directions by path and depth."""
    row = about.first()
    out: dict = {"class": row["class"], "direct": row["uses_in"], "uses_out": row["uses_out"], "owns_parent": row["owns_parent"], "owns_children": row["children"] or []}
    out |= {"target": row["path"]} if requested is None else {"requested": requested, "resolved": row["path"]}
    for direction in ("upstream", "downstream"):
        rows = found.filter(F.col("direction") == direction).orderBy("depth", "path").toLocalIterator()
        out[direction] = [{"path": r["path"], "depth": r["depth"]} for r in rows]
    out["transitive"] = len(out["upstream"])
    return _dump(out)


def radius_text(about: DataFrame, found: DataFrame, *, verbose: bool = False) -> str:
    row = about.first()
    counts = {r["direction"]: r["count"] for r in found.groupBy("direction").count().collect()}
    lines = [f"target\t{row['path']}", f"class\t{row['class']}", f"direct\t{row['uses_in']}", f"transitive\t{counts.get('upstream', 0)}", f"depends on\t{counts.get('downstream', 0)}"]
    if verbose:
        lines += [f"  {r['path']}" for r in found.filter("direction = 'upstream'").orderBy("path").toLocalIterator()]
    return "\n".join(lines)


def ranking_json(ranked: DataFrame) -> str:
    return _dump({"ranking": [r.asDict() for r in ranked.orderBy("position").collect()]})


def ranking_text(ranked: DataFrame) -> str:
    return "\n".join(f"{r['position']:>4}  {r['impact']:>8}  {r['class']:<12}  {r['path']}" for r in ranked.orderBy("position").collect())


def structure_json(structure) -> str:
    """Modules, dependencies, cycles, order and blocks of a Structure; module radii stay out."""
    order = structure.order.orderBy("ordinal").collect()
    blocks: dict[int, list[str]] = {}
    for r in order:
        if r["block"] is not None:
            blocks.setdefault(r["block"], []).append(r["path"])
    return _dump(
        {
            "modules": [r["path"] for r in structure.modules.orderBy("path").collect()],
            "dependencies": [r.asDict() for r in structure.dependencies.orderBy("src", "dst").collect()],
            "cycles": [r["members"] for r in structure.cycles.orderBy("label").collect()],
            "order": [r["path"] for r in order],
            "blocks": [blocks[k] for k in sorted(blocks)],
        }
    )


def structure_text(structure) -> str:
    out = ["cycles:"] + [f"  {', '.join(r['members'])}" for r in structure.cycles.orderBy("label").collect()]
    out += ["dependencies:"] + [f"  {r['src']} -> {r['dst']} ({r['weight']})" for r in structure.dependencies.orderBy("src", "dst").collect()]
    return "\n".join(out + ["order:"] + [f"  {'#' if r['block'] is not None else ' '} {r['path']}" for r in structure.order.orderBy("ordinal").collect()])


def radii_by_index(structure) -> DataFrame:
    """(ordinal, direction, others): module radii as positions in the order, for a viewer."""
    place = structure.order.select("ordinal", "path")
    radii = structure.radii.join(place.withColumnsRenamed({"path": "module"}), "module")
    radii = radii.join(place.select(F.col("ordinal").alias("other_at"), F.col("path").alias("other")), "other")
    return radii.groupBy("ordinal", "direction").agg(F.sort_array(F.collect_list("other_at")).alias("others"))


def matrix_cells(structure) -> DataFrame:
    """(i, j, weight): the filled cells of the matrix, by position."""
    place = structure.order.select("ordinal", "path")
    cells = structure.dependencies.join(place.select(F.col("ordinal").alias("i"), F.col("path").alias("src")), "src")
    return cells.join(place.select(F.col("ordinal").alias("j"), F.col("path").alias("dst")), "dst").select("i", "j", "weight")


def folded(dependencies: DataFrame, depth: int) -> DataFrame:
    """(src, dst, weight) with modules of more than `depth` segments folded into the one above them of that depth.

    Weights add up; what a folded module uses within itself is no dependency any more. A module is
    contained in those whose path begins its own.
    """
    up = lambda c: F.substring_index(c, "::", depth).alias(c)
    rows = dependencies.select(up("src"), up("dst"), "weight").filter("src != dst")
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def folded_matrix(structure, closed: DataFrame) -> DataFrame:
    """(i, j, weight) of the matrix in which the modules of closed(path) show as one row, with all that they contain.

    A module goes to the outermost closed one above it or itself, and rows stand in the order of the
    first of their members. Weights within a row are left out.
    """
    order = structure.order.select("ordinal", "path")
    parts = F.split("path", "::")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "::"))
    into = order.select("ordinal", "path", F.posexplode(above).alias("k", "shown")).join(closed.select(F.col("path").alias("shown")).distinct(), "shown", "left_semi")
    into = into.groupBy("ordinal", "path").agg(F.min_by("shown", "k").alias("shown"))
    rows = order.join(into.select("path", "shown"), "path", "left").withColumn("shown", F.coalesce("shown", "path"))
    first = rows.groupBy("shown").agg(F.min("ordinal").alias("first"))
    places = numbered(first, ["first"], "row").select("shown", "row")
    rows = rows.select("path", "shown").join(places, "shown").select("path", "row")
    cells = structure.dependencies.join(rows.withColumnsRenamed({"path": "src", "row": "i"}), "src").join(rows.withColumnsRenamed({"path": "dst", "row": "j"}), "dst")
    return cells.filter("i != j").groupBy("i", "j").agg(F.sum("weight").alias("weight"))


def comparison_lines(comparison) -> DataFrame:
    """(part, value): each module pair, dependency and item of a Comparison as one JSON object on a line of its own.

    What a comparison as one document would gather in lists stays rows here, for Spark to write.
    """
    part = lambda name, df, *columns: df.select(F.lit(name).alias("part"), F.to_json(F.struct(*columns)).alias("value"))
    out = part("module", comparison.pairs, "key", "path_before", "path_after")
    out = out.unionByName(part("dependency", comparison.deltas, "src_key", "dst_key", "weight_before", "weight_after"))
    out = out.unionByName(part("item", comparison.items.filter("status = 'paired'"), "kind", "trait", "name", "before", "after"))
    for status in ("ambiguous", "only_before", "only_after"):
        out = out.unionByName(part(status, items_with(comparison.items, *comparison.item_rows, status), "side", "kind", "trait", "name", "path"))
    return out


def comparison_json(comparison, name_before: str, name_after: str) -> str:
    """One document, for comparisons that somebody reads as a whole; comparison_lines has the rows."""
    pairs, deltas = comparison.pairs.collect(), comparison.deltas.collect()
    items: dict[str, dict[tuple, dict]] = {s: {} for s in ("paired", "ambiguous", "only_before", "only_after")}
    for status, found in items.items():
        for r in items_with(comparison.items, *comparison.item_rows, status).orderBy("kind", "trait", "name", "path").toLocalIterator():
            entry = found.setdefault((r["kind"], r["trait"], r["name"]), {"kind": r["kind"], "trait": r["trait"], "name": r["name"], "before": [], "after": []})
            entry[r["side"]].append(r["path"])
    return _dump(
        {
            "before": name_before,
            "after": name_after,
            "paired": sorted([r["path_before"], r["path_after"]] for r in pairs if r["path_before"] and r["path_after"]),
            "unpaired_before": sorted(r["path_before"] for r in pairs if not r["path_after"]),
            "unpaired_after": sorted(r["path_after"] for r in pairs if not r["path_before"]),
            "dependencies": [r.asDict() for r in sorted(deltas, key=lambda r: (r["src_key"], r["dst_key"]))],
            "items": {s: list(found.values()) for s, found in items.items()},
        }
    )


def _titled(title: str, rows: list[str]) -> list[str]:
    return ["", title, *(f"  {r}" for r in rows)] if rows else []


def comparison_text(comparison, name_before: str, name_after: str) -> str:
    """Counts of both levels, what one side lacks, the largest changes of weight, items by kind and by crate."""
    pairs, deltas = comparison.pairs.orderBy("key").collect(), comparison.deltas.orderBy("src_key", "dst_key").collect()
    alone = {"before": [r["path_before"] for r in pairs if r["path_after"] is None], "after": [r["path_after"] for r in pairs if r["path_before"] is None]}
    gone, new = [r for r in deltas if r["weight_after"] is None], [r for r in deltas if r["weight_before"] is None]
    status = {r["status"]: r["count"] for r in comparison.items.groupBy("status").count().collect()}
    kinds = comparison.items.filter("status = 'paired'").groupBy("kind").count().orderBy("kind").collect()
    out = [
        f"{name_before} ({comparison.natures[0]}) -> {name_after} ({comparison.natures[1]}), modules paired by {comparison.mode}",
        f"modules: {len(pairs) - len(alone['before']) - len(alone['after'])} paired, {len(alone['before'])} only before, {len(alone['after'])} only after",
        f"dependencies: {len(deltas) - len(gone) - len(new)} common, {len(gone)} gone, {len(new)} new",
        "items: " + ", ".join(f"{status.get(s, 0)} {s.replace('_', ' ')}" for s in ("paired", "ambiguous", "only_before", "only_after")),
    ]
    if any(comparison.removed_third_party):
        out.append("third-party nodes left out: {} before, {} after".format(*comparison.removed_third_party))
    for side, paths in alone.items():
        out += _titled(f"modules only {side}:", paths)
    out += _titled("dependencies gone:", [f"{r['src_key']} -> {r['dst_key']} ({r['weight_before']})" for r in gone])
    out += _titled("new dependencies:", [f"{r['src_key']} -> {r['dst_key']} ({r['weight_after']})" for r in new])
    out += _titled("largest changes of weight:", [f"{r['src_key']} -> {r['dst_key']}: {r['weight_before']} -> {r['weight_after']}" for r in top_weight_deltas(comparison.deltas).collect()])
    out += _titled("paired items by kind:", [f"{r['kind']} {r['count']}" for r in kinds])
    out += _titled("items of one side by crate:", [f"{r['crate']}: {r['n_before']} before, {r['n_after']} after" for r in unpaired_by_crate(comparison.items, *comparison.item_rows).orderBy("crate").collect()])
    return "\n".join(out)


def diff_json(touched: DataFrame, classes: DataFrame, found: DataFrame, names: DataFrame, census: DataFrame, ghosts: DataFrame | None = None) -> str:
    """Touched nodes with class and sizes of their radius, the radius of all together, untracked files, ghosts.

    touched: (id, path); classes: (id, class); found: (target, direction, node, depth); names: (id, path).
    """
    size = lambda d: F.count_if(F.col("direction") == d).alias(d)
    sizes = found.groupBy(F.col("target").alias("id")).agg(size("upstream"), size("downstream"))
    each = touched.join(classes.select("id", "class"), "id").join(sizes, "id", "left").fillna(0, ["upstream", "downstream"])
    every = combined(found).join(names.select(F.col("id").alias("node"), "path"), "node").orderBy("depth", "path")
    reached = lambda d: [{"path": r["path"], "depth": r["depth"]} for r in every.filter(F.col("direction") == d).toLocalIterator()]
    files = lambda b: [r["file"] for r in census.filter(F.col("bucket") == b).orderBy("file").toLocalIterator()]
    return _dump(
        {
            "touched": [r.asDict() for r in each.select("path", "id", "class", "upstream", "downstream").orderBy("path", "id").toLocalIterator()],
            "combined": {d: reached(d) for d in ("upstream", "downstream")},
            **{b: files(b) for b in ("linked", "loose", "non_source")},
            "ghosts": [r.asDict() for r in ghosts.orderBy("path").toLocalIterator()] if ghosts is not None else [],
        }
    )


def diff_text(touched: DataFrame, census: DataFrame, found_paths: DataFrame, view: str = "summary") -> str:
    """view: "summary", "item" (every touched path) or "layers" (touched names by crate).

    Where nothing depends on the change but new files are linked, what they use comes first.
    """
    files = [(r["bucket"], r["name"]) for r in census.select("bucket", basename(F.col("file")).alias("name")).orderBy("bucket", "name").toLocalIterator()]
    buckets = {b: [name for bucket, name in files if bucket == b] for b in ("linked", "loose", "non_source")}
    if view == "item":
        body = [r["path"] for r in touched.orderBy("path", "id").toLocalIterator()]
    elif view == "layers":
        grouped = touched_by_crate(touched).groupBy("crate").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
        body = [f"{r['crate']}: {r['names']}" for r in grouped.orderBy("crate").collect()]
    else:
        counts = {d: by_crate(found_paths.filter(F.col("direction") == d)).collect() for d in ("upstream", "downstream")}
        order = ("downstream", "upstream") if buckets["linked"] and not counts["upstream"] else ("upstream", "downstream")
        body = [f"{d}: " + (", ".join(f"{r['crate']} {r['n']}" for r in counts[d]) or "-") for d in order]
    foot = [f"untracked, {b.replace('_', ' ')}: {len(names)}" + (f" ({', '.join(names)})" if names else "") for b, names in buckets.items()]
    return "\n".join([*body, *foot])
