"""Queries over the boundary (documents, catalogues), whole analyses and measurements, with their SQL."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow import queries as Q
from undertow.functions import base_kind, basename, crate_of, short_name
from undertow.graph import Graph
from undertow.operators import compare, diffing, filters, measures, modules, scc, workspace
from undertow.plans import analyses
from undertow.runtime import discard_folder, shared_dir
from undertow.schema import KINDS
from undertow.sources import catalog
from undertow.sources import projections as P
from undertow.sources.json_graph import parse_uses_kind, read_graph, violations, visibility_is_valid

QUERIES: dict[str, Q.Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f: Q.Query) -> Q.Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = P.plain_sql(sql)
        return f

    return register


# --- documents at the boundary -------------------------------------------------------------------

#: Nodes and edges with every kind of fault: ids met twice, unknown values, ends that are not there.
_FAULTY_NODES = """
  select case when p_partkey % 97 = 0 then p_partkey - 1 else p_partkey end id, concat('p::P', cast(p_partkey as string)) path,
    case p_partkey % 13 when 0 then 'gadget' when 1 then 'enum' when 2 then cast(null as string) else 'fn' end kind,
    case p_partkey % 5 when 0 then 'pub' when 1 then 'pub(crate)' when 2 then 'pub(in p::q)' when 3 then 'pub(in  )' else 'private' end visibility
  from {part}"""
_FAULTY_EDGES = """
  select p_partkey src, p_partkey + p_partkey % 7 dst, case p_partkey % 3 when 0 then 'owns' when 1 then 'uses' else 'likes' end relation, cast(null as string) uses_kind
  from {part}"""


@_query(f"with nodes as ({_FAULTY_NODES}), edges as ({_FAULTY_EDGES})" + f"""
select 'unknown kind' rule, kind "value" from nodes where coalesce(kind not in {KINDS}, true) union all
select 'unknown visibility', visibility from nodes where visibility not in ('pub', 'pub(crate)', 'pub(super)', 'priv') and not (visibility like 'pub(in %)' and trim(substr(visibility, 8, length(visibility) - 8)) != '') union all
select 'unknown relation', relation from edges where relation not in ('owns', 'uses') union all
select 'duplicate id', cast(id as varchar) from nodes group by id having count(*) > 1 union all
select 'dangling src', cast(src as varchar) from edges where src not in (select id from nodes) union all
select 'dangling dst', cast(dst as varchar) from edges where dst not in (select id from nodes)""")
def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(Graph.of(P.select(spark, sf_dir, _FAULTY_NODES), P.select(spark, sf_dir, _FAULTY_EDGES)))


_WIRE = """
  select o_orderkey, concat(case o_orderkey % 3 when 0 then 'const unsafe ' when 1 then 'async ' else '' end, case o_orderkey % 2 when 0 then 'fn' else 'trait' end) kind,
    case o_orderkey % 2 when 0 then 'uses' else 'owns' end relation, case o_orderkey % 5 when 0 then 'reference' when 1 then cast(null as string) when 2 then '' else 'import' end uses_kind,
    case o_orderkey % 4 when 0 then 'priv' when 1 then 'pub(in a::b)' when 2 then 'pub(in )' else 'Pub' end visibility
  from {orders}"""


@_query(f"with wire as ({_WIRE})" + """ select o_orderkey, split_part(kind, ' ', -1) base_kind,
  case when relation = 'uses' and uses_kind is not null then case uses_kind when 'reference' then 'reference' else 'import' end end uses_kind,
  visibility in ('priv', 'pub(in a::b)') is_valid from wire""")
def wire_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = P.select(spark, sf_dir, _WIRE)
    return wire.select("o_orderkey", base_kind(F.col("kind")).alias("base_kind"), parse_uses_kind(F.col("relation"), F.col("uses_kind")).alias("uses_kind"), visibility_is_valid(F.col("visibility")).alias("is_valid"))


#: Documents to a file at most: a compressed file is read by one task.
_FILE_OF_DOCUMENTS = 100_000


def _orders_as_documents(spark: SparkSession, sf_dir: str) -> Graph:
    """One JSON document for each order: the order owns its lines, and each line uses the one before.

    Keys travel and become text where they are written; the text is compressed, and goes when the graph is stored."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag").repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    orders = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("lines"))  # seven lines at most
    order, path = F.col("l_orderkey") * 100, F.concat(F.lit("o::O"), F.col("l_orderkey").cast("string"))
    item = lambda x: order + x["l_linenumber"]
    text = lambda x: x["l_linenumber"].cast("string")
    node = lambda x: F.struct(item(x).alias("id"), F.concat(path, F.lit("::L"), text(x)).alias("path"), F.concat(F.lit("L"), text(x)).alias("name"), F.lit("async fn").alias("kind"), F.lit("priv").alias("visibility"), (x["l_returnflag"] == "R").alias("is_async"))
    owned = lambda x: F.struct(order.alias("id_from"), item(x).alias("id_to"), F.lit("owns").alias("relation"), F.lit("reference").alias("uses_kind"))
    used = lambda x: F.struct(item(x).alias("id_from"), order.alias("id_to"), F.lit("uses").alias("relation"), x["l_returnflag"].alias("uses_kind"))
    root = F.struct(order.alias("id"), path.alias("path"), path.alias("name"), F.lit("mod").alias("kind"), F.lit("pub").alias("visibility"), F.lit(None).cast("boolean").alias("is_async"))
    edges = F.flatten(F.transform("lines", lambda x: F.array(owned(x), used(x))))
    documents = orders.select(F.lit("o").alias("crate"), F.concat(F.array(root), F.transform("lines", node)).alias("nodes"), edges.alias("edges"))
    folder = f"{shared_dir(spark)}/documents-{uuid4().hex}"
    documents.write.option("compression", "gzip").option("maxRecordsPerFile", _FILE_OF_DOCUMENTS).json(folder)
    graph = read_graph(spark, folder, lines=True)
    discard_folder(spark, folder)
    return graph


@_query("""select distinct l_orderkey * 100 id, concat('o::O', cast(l_orderkey as varchar)) path, 'mod' kind, 'pub' visibility, false is_async from {lineitem} union all
select l_orderkey * 100 + l_linenumber, concat('o::O', cast(l_orderkey as varchar), '::L', cast(l_linenumber as varchar)), 'fn', 'priv', max(l_returnflag) = 'R' from {lineitem} group by l_orderkey, l_linenumber""")
def json_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_as_documents(spark, sf_dir).nodes.select("id", "path", "kind", "visibility", "is_async")


@_query("""select distinct l_orderkey * 100 src, l_orderkey * 100 + l_linenumber dst, 'owns' relation, cast(null as varchar) uses_kind from {lineitem} union all
select distinct l_orderkey * 100 + l_linenumber, l_orderkey * 100, 'uses', 'import' from {lineitem}""")
def json_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_as_documents(spark, sf_dir).edges.select("src", "dst", "relation", "uses_kind")


# --- catalogues ----------------------------------------------------------------------------------


@_query("""select c_custkey, case when c_custkey % 4 in (0, 3) then 'lib' when c_custkey % 4 = 1 then concat('bin:b', cast(c_custkey as varchar)) end target from {customer}""")
def target_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    target = lambda name, kind: F.struct(name.alias("name"), F.array(F.lit(kind)).alias("kind"))
    own, other = F.concat(F.lit("b"), F.col("c_custkey").cast("string")), F.lit("other")
    kinds = {0: ("bin", "lib"), 1: ("bin", "custom-build"), 2: ("bin", "bin"), 3: ("cdylib", "bin")}
    targets = F.coalesce(*[F.when(F.col("c_custkey") % 4 == k, F.array(target(own, a), target(other, b))) for k, (a, b) in kinds.items()])
    return rows.select("c_custkey", catalog.chosen_target(targets).alias("target"))


@_query("select concat('n', cast(s_nationkey as varchar)) name, concat('/w/', cast(s_suppkey as varchar), '/Cargo.toml') manifest_path, 'lib' target from {supplier} where s_nationkey = 3 order by manifest_path limit 1")
def package_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    library = F.array(F.struct(F.lit("x").alias("name"), F.array(F.lit("lib")).alias("kind")))
    packages = rows.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("name"), F.concat(F.lit("/w/"), F.col("s_suppkey").cast("string"), F.lit("/Cargo.toml")).alias("manifest_path"), library.alias("targets"))
    return catalog.find_package(packages, name="n3").select("name", "manifest_path", "target")


_DIRS = "select concat('crates/n', cast(c_nationkey as string), '/c', cast(c_custkey as string)) dir, case when c_custkey % 7 != 0 then concat('c', cast(c_custkey as string)) end name from {customer}"


@_query(f"with dirs as ({_DIRS}) select name, dir from dirs where (dir like 'crates/n1%/c%' or dir like 'crates/n2/c%5') and dir not like 'crates/%/c1%' and name is not null")
def member_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.workspace_members(P.select(spark, sf_dir, _DIRS), ["crates/n1*/c*", "./crates/n2/c*5", "crates/n1/*"], ["crates/*/c1*"])


@_query(Q._TRADE + " select id, case when instr(path, '::') > 0 then substr(path, instr(path, '::') + 2) else path end short, split_part(replace(path, '::', '/'), '/', -1) base from nodes")
def names_within_crate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.trade_graph(spark, sf_dir).nodes
    return nodes.select("id", short_name(F.col("path"), crate_of(F.col("path"))).alias("short"), basename(F.replace("path", F.lit("::"), F.lit("/"))).alias("base"))


# --- whole analyses ------------------------------------------------------------------------------


@_query(Q._TRADE + ", target as (select cast(2000003 as bigint) id)" + Q._walk("upstream") + Q._walk("downstream") + """
select 'upstream' direction, path, depth from upstream join nodes on id = node union all
select 'downstream', path, depth from downstream join nodes on id = node""")
def radius_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.analyse_radius(P.trade_graph(spark, sf_dir), node_id=2000003)[1]


@_query(Q._DIFF + Q._TOUCHED + " select distinct 'flow' crate, substr(path, 7) name from touched")
def touched_names_by_crate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.touched_by_crate(diffing.touched_nodes(Q._placed(spark, sf_dir), P.select(spark, sf_dir, P.HUNKS)))


@_query(Q._TRADE + " select split_part(path, '::', 1) in ('tpch', 'std-like') kept, count(*) n from nodes group by 1")
def third_party_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir)
    members = spark.createDataFrame([("tpch",), ("std-like",)], "name string")
    kept = filters.keep_members(graph, members).nodes.select("id", F.lit(True).alias("kept"))
    return graph.nodes.join(kept, "id", "left").groupBy(F.coalesce("kept", F.lit(False)).alias("kept")).agg(F.count("*").alias("n"))


# --- keys of items -------------------------------------------------------------------------------


def _shop(crate: str, of_order: str, of_customer: str) -> tuple[str, str]:
    """Customers (types, aliases or modules) and the orders that they own; orders of a customer share names."""
    nodes = f"""
  select cast(-1 as bigint) id, '{crate}' path, 'crate' kind, cast(null as string) "trait", cast(null as string) trait_ref union all
  select c_custkey, concat('{crate}::C', cast(c_custkey as string)), case c_custkey % 5 when 0 then 'type' when 1 then 'enum' when 2 then 'mod' else 'struct' end, cast(null as string), cast(null as string)
  from {{customer}} where {of_customer} union all
  select 10000000 + o_orderkey, concat('{crate}::C', cast(o_custkey as string), '::f', cast(o_orderkey % 9 as string)), 'fn',
    case when o_orderkey % 3 = 0 then 'Ship' end, case when o_orderkey % 4 = 0 then 'Ship<X>' end
  from {{orders}} where {of_order}"""
    edges = f"""
  select cast(-1 as bigint) src, c_custkey dst, 'owns' relation, cast(null as string) uses_kind from {{customer}} where {of_customer} union all
  select o_custkey, 10000000 + o_orderkey, 'owns', cast(null as string) from {{orders}} where {of_order}"""
    return nodes, edges


_SHOPS = (_shop("shop", "o_orderkey % 8 != 1", "c_custkey % 17 != 3"), _shop("store", "o_orderkey % 7 != 0", "c_custkey % 11 != 0"))
_SHOP_SIDES = "with " + ", ".join(f"{side}_nodes as ({n}), {side}_edges as ({e})" for side, (n, e) in zip(("before", "after"), _SHOPS))
_QUALIFIED = "".join(f""", {side}_all as (
  select n.id, n.path, n.kind, n."trait", n.trait_ref, split_part(n.path, '::', -1) plain,
    case when o.kind in ('struct', 'enum', 'union', 'trait') then concat(split_part(o.path, '::', -1), '::', split_part(n.path, '::', -1)) else split_part(n.path, '::', -1) end qualified
  from {side}_nodes n left join {side}_edges e on e.dst = n.id left join {side}_nodes o on o.id = e.src
  where n.kind not in ('mod', 'crate', 'builtin'))""" for side in ("before", "after"))
_KEY_SQL = {
    "name": ("''", "plain", "true"),
    "inherent_name": ("''", "plain", "\"trait\" is null and trait_ref is null"),
    "owner_name": ("''", "qualified", "true"),
    "trait_owner_name": ("coalesce(\"trait\", '')", "qualified", "true"),
}


def _keys_sql(key: str, ghosts: str = "true") -> str:
    """One subquery: the keys with their numbers of items on both sides."""
    trait, name, kept = _KEY_SQL[key]
    side = lambda s: f"select kind, {trait} t, {name} name, count(*) n, min(path) first from {s}_all where {kept} and {ghosts} group by 1, 2, 3"
    return f"""(select '{key}' item_key, coalesce(b.kind, a.kind) kind, coalesce(b.t, a.t) "trait", coalesce(b.name, a.name) name, coalesce(b.n, 0) nb, coalesce(a.n, 0) na
  from ({side('before')}) b full join ({side('after')}) a on a.kind = b.kind and a.t = b.t and a.name = b.name)"""


def _shops(spark: SparkSession, sf_dir: str) -> list[Graph]:
    return [Graph.of(P.select(spark, sf_dir, n), P.select(spark, sf_dir, e)) for n, e in _SHOPS]


@_query(_SHOP_SIDES + _QUALIFIED + " select item_key, cast(sum(nb) as bigint) items_before, cast(sum(na) as bigint) items_after, count(*) filter (where nb > 0) keys_before, count(*) filter (where na > 0) keys_after, count(*) filter (where nb = 1 and na = 1) n_paired, count(*) filter (where nb > 0 and na > 0 and nb + na > 2) n_ambiguous, count(*) filter (where na = 0) n_only_before, count(*) filter (where nb = 0) n_only_after, cast(coalesce(sum(nb + na) filter (where nb > 0 and na > 0 and nb + na > 2), 0) as bigint) n_ambiguous_items from (" + " union all ".join(f"select * from {_keys_sql(k)}" for k in compare.ITEM_KEYS) + ") k group by item_key")
def key_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _shops(spark, sf_dir)
    rows = [compare.key_measures(compare.item_pairs(compare.item_keys(before, key=k), compare.item_keys(after, key=k))).withColumn("item_key", F.lit(k)) for k in compare.ITEM_KEYS]
    return reduce(DataFrame.unionByName, rows)


@_query(_SHOP_SIDES + _QUALIFIED + f" select kind, \"trait\", name, nb n_before, na n_after from {_keys_sql('trait_owner_name')} k where nb > 0 and na > 0 order by nb + na desc, kind, \"trait\", name limit 10")
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.largest_common_keys(compare.item_pairs(*(compare.item_keys(g) for g in _shops(spark, sf_dir))))


@_query(_SHOP_SIDES + _QUALIFIED + f" select kind, \"trait\", name, nb n_before, na n_after from {_keys_sql('trait_owner_name', chr(39) + '%::C%5' + chr(39) + ' is not null and path not like ' + chr(39) + '%::C%5' + chr(39))} k")
def keys_without_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = _shops(spark, sf_dir)
    pairs = compare.item_pairs(*(compare.item_keys(g, g.nodes.filter("path like '%::C%5'").select("path")) for g in graphs))
    return pairs.select("kind", "trait", "name", "n_before", "n_after")


@_query(_SHOP_SIDES + " select coalesce(b.kind, a.kind) kind, coalesce(b.n, 0) n_before, coalesce(a.n, 0) n_after from (select kind, count(*) n from before_nodes group by kind) b full join (select kind, count(*) n from after_nodes group by kind) a on a.kind = b.kind")
def kinds_of_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.kind_distribution(*_shops(spark, sf_dir))


@_query(Q._ITEMS + " select split_part(path, '::', 1) crate, count(*) filter (where status = 'only_before') n_before, count(*) filter (where status = 'only_after') n_after from (select status, unnest(coalesce(before, after)) path from items where status in ('only_before', 'only_after')) u group by 1")
def unpaired_by_crate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.unpaired_by_crate(*Q._items(spark, sf_dir))


# --- measurements --------------------------------------------------------------------------------


def _second_closure(uses: str) -> str:
    """Components once more, over other edges; and the nodes that are in a cycle either time."""
    again = Q._CLOSURE
    for name in ("closure", "parts", "uses"):
        again = again.replace(f"{name} ", f"{name}2 ").replace(f"from {name}2 union", f"from {name}2 union")
    return f", uses2 as ({uses})" + again + """, rings as (select path from parts where label in (select label from parts group by label having count(*) > 1)),
rings2 as (select path from parts2 where label in (select label from parts2 group by label having count(*) > 1))
select coalesce(a.path, b.path) path, a.path is not null cyclic_before, b.path is not null cyclic_after from rings a full join rings2 b on a.path = b.path"""


@_query(Q._QUOTIENT + Q._CLOSURE + _second_closure("select u.src, u.dst from uses u where u.src != 100 and u.dst != 100"))
def cycles_without_a_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotient = Q._quotient(spark, sf_dir)
    rest = measures.without_node(quotient, "tpch::R0::N0").stored()
    return measures.cycle_changes(scc.components(quotient), scc.components(rest))


@_query(Q._QUOTIENT.replace("where relation = 'uses' and a.module", "where relation = 'uses' and uses_kind is not null and a.module").replace("select a.module src, b.module dst from", "select a.module src, b.module dst, uses_kind from") + Q._CLOSURE + _second_closure("select distinct src, dst from crossing where uses_kind = 'reference'"))
def cycles_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.market_graph(spark, sf_dir).stored()
    contained = modules.containing_modules(graph)
    views = [modules.module_graph(g, contained).stored() for g in (graph, filters.reference_only(graph))]
    return measures.cycle_changes(*map(scc.components, views))


@_query(Q._TRADE + """, climb as (
  select id target, id node, 0 depth from nodes where kind = 'fn' union all
  select target, src, depth + 1 from climb join edges on dst = node and relation = 'owns')
select target, node, cast(depth as bigint) depth from climb where depth > 0""")
def owners_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir).stored()
    return measures.ancestors(graph, graph.nodes.filter("kind = 'fn'").select("id"))


@_query(Q._CHAT + " select id, path from nodes where \"trait\" is null and trait_ref is null")
def light_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.light_nodes(P.chat_graph(spark, sf_dir)).select("id", "path")


@_query(f"with hunks as (select file from ({P.HUNKS}) h), files as (select file from ({P.CHANGED_FILES}) f) select distinct file, 'first' side from hunks where file not in (select file from files) union all select distinct file, 'second' from files where file not in (select file from hunks)")
def reader_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.file_differences(P.select(spark, sf_dir, P.HUNKS), P.select(spark, sf_dir, P.CHANGED_FILES))


def _depth_sql(name: str, nodes: str, edges: str) -> str:
    near = {"upstream": ("dst", "src"), "downstream": ("src", "dst")}
    walks = "".join(f""", {name}_{d} as (
  select n.path target, n.id node from {nodes} n join target on target.path = n.path union
  select w.target, e.{far} from {name}_{d} w join {edges} e on e.{a} = w.node)""" for d, (a, far) in near.items())
    counts = " union all ".join(f"select '{d}' direction, count(*) - 1 n from {name}_{d}" for d in near)
    return walks + f", {name}_sizes as ({counts})"


@_query(Q._CRATES.replace("with nodes", "with recursive nodes") + Q._CHOSEN + """, target as (select min(path) path from nodes where label = 'R2' and split_part(path, '::', 1) = 'R2'),
local_nodes as (select id, path from nodes where label = 'R2'), local_edges as (select src, dst from edges where label = 'R2' and relation = 'uses'),
whole_edges as (select distinct s.new_id src, d.new_id dst from edges e join nodes a on a.label = e.label and a.id = e.src join nodes b on b.label = e.label and b.id = e.dst
  join numbered s on s.path = a.path join numbered d on d.path = b.path where relation = 'uses'),
whole_nodes as (select new_id id, path from numbered)""" + _depth_sql("local", "local_nodes", "local_edges") + _depth_sql("whole", "whole_nodes", "whole_edges") + """
select (select path from target) path, l.direction, l.n n_local, w.n n_whole, w.n - l.n change from local_sizes l join whole_sizes w on w.direction = l.direction""")
def radius_in_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = Q._labelled(spark, sf_dir)
    local = Graph(every.nodes.filter("label = 'R2'"), every.edges.filter("label = 'R2'"), "R2")
    first = local.nodes.filter("path like 'R2::%'").agg(F.min("path").alias("path"))
    return measures.radius_deltas(local, workspace.unite(every).graph.stored(), first)
