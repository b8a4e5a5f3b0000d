"""Two versions of a graph: modules, dependencies and items side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.functions import crate_of, normalized_key
from undertow.graph import Graph
from undertow.operators.degrees import owns_parents
from undertow.schema import TYPE_KINDS, GraphError

_NO_ITEMS = ("mod", "crate", "builtin")
#: What tells items apart beside their kind: the name; the name, of items outside trait implementations;
#: the name with its owner; the name with its owner, and the trait.
ITEM_KEYS = ("name", "inherent_name", "owner_name", "trait_owner_name")


def pairing_key(path: Column, mode: str) -> Column:
    """mode: "full_path", or "normalized", which leaves out the first segment."""
    if mode not in ("full_path", "normalized"):
        raise GraphError(f"unknown pairing mode: {mode}")
    return normalized_key(path) if mode == "normalized" else path


def _keyed(modules: DataFrame, mode: str, name: str) -> DataFrame:
    """Of modules with one key, the last path stands."""
    return modules.groupBy(pairing_key(F.col("path"), mode).alias("key")).agg(F.max("path").alias(name))


def module_pairs(before: DataFrame, after: DataFrame, mode: str) -> DataFrame:
    """(key, path_before, path_after) over both sides' modules(path); one of the paths is null for a module without a pair."""
    return _keyed(before, mode, "path_before").join(_keyed(after, mode, "path_after"), "key", "full")


def edge_deltas(before: DataFrame, after: DataFrame, pairs: DataFrame, mode: str) -> DataFrame:
    """Dependencies between paired modules: (src_key, dst_key, weight_before, weight_after), null where absent.

    before, after: (src, dst, weight) by module path. Of dependencies with one key, the last by path stands.
    """
    paired = pairs.filter("path_before is not null and path_after is not null").select("key")

    def side(deps: DataFrame, name: str) -> DataFrame:
        keyed = deps.select(pairing_key(F.col("src"), mode).alias("src_key"), pairing_key(F.col("dst"), mode).alias("dst_key"), "src", "dst", "weight")
        for end in ("src_key", "dst_key"):
            keyed = keyed.join(paired.withColumnRenamed("key", end), end, "left_semi")
        return keyed.groupBy("src_key", "dst_key").agg(F.max_by("weight", F.struct("src", "dst")).alias(name))

    return side(before, "weight_before").join(side(after, "weight_after"), ["src_key", "dst_key"], "full")


def top_weight_deltas(deltas: DataFrame, top: int = 10) -> DataFrame:
    """The common dependencies whose weight changed most, ties by key."""
    change = F.col("weight_after") - F.col("weight_before")
    changed = deltas.filter("weight_before is not null and weight_after is not null and weight_before != weight_after").withColumn("change", change)
    return changed.orderBy(F.desc(F.abs("change")), "src_key", "dst_key").limit(top)


def item_keys(graph: Graph, ghosts: DataFrame | None = None, key: str = "trait_owner_name") -> DataFrame:
    """(kind, trait, name, path): each item with its kind, trait and name, qualified by the owner if that is a type.

    key: one of ITEM_KEYS; the coarser ones leave the trait empty, or the owner out as well.
    """
    if key not in ITEM_KEYS:
        raise GraphError(f"unknown item key: {key}")
    items = graph.nodes.filter(~F.col("kind").isin(*_NO_ITEMS))
    if key == "inherent_name":
        items = items.filter("`trait` is null and trait_ref is null")
    trait = F.coalesce("trait", F.lit("")) if key == "trait_owner_name" else F.lit("")
    items = items.select("id", "path", "name", "kind", trait.alias("trait"))
    if ghosts is not None:
        items = items.join(ghosts.select("path"), "path", "left_anti")
    if not key.endswith("owner_name"):
        return items.select("kind", "trait", "name", "path")
    owner = graph.nodes.select(F.col("id").alias("parent"), F.col("name").alias("owner"), F.col("kind").alias("owner_kind"))
    items = items.join(owns_parents(graph).join(owner, "parent"), "id", "left")
    full = F.when(F.col("owner_kind").isin(*TYPE_KINDS), F.concat("owner", F.lit("::"), "name")).otherwise(F.col("name"))
    return items.select("kind", "trait", full.alias("name"), "path")


_KEY = ["kind", "trait", "name"]


def item_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, trait, name, n_before, n_after, before, after, status) over two item_keys frames, one row for each key.

    status: paired (one path on each side), ambiguous (on both sides, but more than one on either),
    only_before or only_after. before and after are the paths of a pair, else null: paths of a
    crowded key stay rows of the item_keys frames, where items_with finds them.
    """
    side = lambda df, name: df.groupBy(*_KEY).agg(F.count("*").alias(f"n_{name}"), F.min("path").alias(name))
    both = side(before, "before").join(side(after, "after"), _KEY, "full").fillna(0, ["n_before", "n_after"])
    one = (F.col("n_before") == 1) & (F.col("n_after") == 1)
    status = F.when(F.col("n_after") == 0, "only_before").when(F.col("n_before") == 0, "only_after").when(one, "paired").otherwise("ambiguous")
    both = both.withColumn("status", status)
    return both.withColumns({c: F.when(F.col("status") == "paired", F.col(c)) for c in ("before", "after")})


def items_with(pairs: DataFrame, before: DataFrame, after: DataFrame, *status: str) -> DataFrame:
    """(side, kind, trait, name, path): the items of both sides whose keys have one of the statuses."""
    wanted = pairs.filter(F.col("status").isin(*status)).select(*_KEY)
    side = lambda df, name: df.join(wanted, _KEY, "left_semi").select(F.lit(name).alias("side"), *_KEY, "path")
    return side(before, "before").unionByName(side(after, "after"))


def unpaired_items(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(side, kind, trait, name, path): the items whose key the other side lacks."""
    return items_with(pairs, before, after, "only_before", "only_after")


def key_census(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: keys that are paired, ambiguous, and on one side only."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return item_pairs(before, after).agg(count("paired"), count("ambiguous"), count("only_before"), count("only_after"))


def unpaired_by_crate(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(crate, n_before, n_after): items whose key one side lacks, by the crate they are in."""
    side = lambda s: F.count_if(F.col("side") == s).alias(f"n_{s}")
    return unpaired_items(pairs, before, after).groupBy(crate_of(F.col("path")).alias("crate")).agg(side("before"), side("after"))


def key_measures(pairs: DataFrame) -> DataFrame:
    """One row on how well a key tells items apart: items and keys of each side, and the fate of the keys.

    n_ambiguous_items counts both sides' items of ambiguous keys.
    """
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    fate = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return pairs.agg(
        total("n_before", "items_before"),
        total("n_after", "items_after"),
        F.count_if(F.col("n_before") > 0).alias("keys_before"),
        F.count_if(F.col("n_after") > 0).alias("keys_after"),
        *map(fate, ("paired", "ambiguous", "only_before", "only_after")),
        total(F.when(F.col("status") == "ambiguous", F.col("n_before") + F.col("n_after")), "n_ambiguous_items"),
    )


def largest_common_keys(pairs: DataFrame, top: int = 10) -> DataFrame:
    """(kind, trait, name, n_before, n_after): the keys of both sides with most items, ties by key."""
    common = pairs.filter("n_before > 0 and n_after > 0").select(*_KEY, "n_before", "n_after")
    return common.orderBy(F.desc(F.col("n_before") + F.col("n_after")), *_KEY).limit(top)
