"""One query for each operator, over graphs drawn from ordinary tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.functions import line_count
from undertow.graph import Graph
from undertow.operators import compare, degrees, diffing, filters, modules, ranking, reach, resolve, scc, workspace
from undertow.operators.dsm import dsm_order
from undertow.runtime import materialize
from undertow.sources import projections as P
from undertow.sources.diff_text import parse_diff

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = P.plain_sql(sql)
        return f

    return register


def _over(nodes: str, edges: str) -> str:
    return f"with recursive nodes as ({nodes}), edges as ({edges}), uses as (select distinct src, dst from edges where relation = 'uses')"


_TRADE, _MARKET, _FLOW, _CHAT = (_over(*g) for g in ((P.TRADE_NODES, P.TRADE_EDGES), (P.MARKET_NODES, P.MARKET_EDGES), (P.FLOW_NODES, P.FLOW_EDGES), (P.CHAT_NODES, P.CHAT_EDGES)))
_DEGREES = """, degrees as (
  select id, path, coalesce(i, 0) uses_in, coalesce(o, 0) uses_out from nodes
  left join (select dst, count(*) i from edges where relation = 'uses' group by dst) a on a.dst = id
  left join (select src, count(*) o from edges where relation = 'uses' group by src) b on b.src = id),
classes as (
  select *, case when uses_in = 0 and uses_out = 0 then 'isolated' when uses_in = 0 then 'leaf' when uses_out = 0 then 'base' else 'intermediate' end class
  from degrees)"""
_CLOSURE = """, closure as (select src, dst from uses union select c.src, u.dst from closure c join uses u on c.dst = u.src),
parts as (
  select n.id, n.path, coalesce(least(n.path, min(m.path)), n.path) label from nodes n
  left join closure c on c.src = n.id left join closure d on d.src = c.dst and d.dst = n.id
  left join nodes m on m.id = c.dst and d.src is not null
  group by n.id, n.path)"""
_MODULE_OF = """, climb as (
  select id, id above, kind in ('mod', 'crate') done from nodes
  union all
  select c.id, e.src, n.kind in ('mod', 'crate') from climb c join edges e on e.dst = c.above and e.relation = 'owns' join nodes n on n.id = e.src where not c.done),
module_of as (select id, above module from climb where done)"""


@_query(_TRADE + _DEGREES + " select * from degrees")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees.degrees(P.trade_graph(spark, sf_dir))


@_query(_TRADE + _DEGREES + " select * from classes")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees.classification(P.trade_graph(spark, sf_dir))


@_query(_TRADE + _DEGREES + " select class, count(*) n, cast(sum(uses_in) as bigint) uses_in from classes group by class")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees.class_distribution(P.trade_graph(spark, sf_dir))


@_query(_TRADE + " select dst id, src parent from edges where relation = 'owns'")
def owns_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees.owns_parents(P.trade_graph(spark, sf_dir))


@_query(_MARKET + " select src id, string_agg(path, ',' order by path) children from edges join nodes on id = dst where relation = 'owns' group by src")
def owns_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees.owns_children(P.market_graph(spark, sf_dir)).withColumn("children", F.array_join("children", ","))


# --- filters -----------------------------------------------------------------------------------


@_query(_TRADE + " select id, path from nodes where split_part(path, '::', 1) not in ('std', 'core', 'alloc', 'proc_macro', 'test')")
def scope_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_scope(P.trade_graph(spark, sf_dir), "own_code").nodes.select("id", "path")


@_query(_TRADE + " select src, dst, relation, uses_kind from edges where src not in (select id from nodes where path like 'core::%') and dst not in (select id from nodes where path like 'core::%')")
def scope_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_scope(P.trade_graph(spark, sf_dir), "own_code").edges.select("src", "dst", "relation", "uses_kind")


@_query(_TRADE + ", kept as (select id, path from nodes where split_part(path, '::', 1) = 'tpch') select k.id, k.path, (select count(*) from edges where src in (select id from kept) and dst in (select id from kept)) n_edges from kept k")
def member_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.keep_members(P.trade_graph(spark, sf_dir), spark.createDataFrame([("tpch",), ("not-there",)], "name string"))
    n_edges = kept.edges.agg(F.count("*").alias("n_edges"))
    return kept.nodes.select("id", "path").join(n_edges, how="cross")  # one row on the right


@_query(_TRADE + " select src, dst, relation, uses_kind from edges where relation = 'owns' or uses_kind = 'reference'")
def reference_only_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_uses_mode(P.trade_graph(spark, sf_dir), "reference_only").edges.select("src", "dst", "relation", "uses_kind")


@_query(_TRADE + " select count(*) n_uses, count(uses_kind) n_typed, count(*) filter (where uses_kind = 'reference') n_reference, count(*) filter (where uses_kind = 'import') n_import from edges where relation = 'uses'")
def uses_kind_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.uses_kind_census(P.trade_graph(spark, sf_dir))


# --- reach and ranking -------------------------------------------------------------------------

_TARGET = ", target as (select min(id) id from nodes where kind = 'fn')"


def _walk(direction: str) -> str:
    near, far = ("dst", "src") if direction == "upstream" else ("src", "dst")
    return f""", walk_{direction} as (
  select id target, id node, 0 depth from target
  union
  select w.target, u.{far}, w.depth + 1 from walk_{direction} w join uses u on u.{near} = w.node where w.depth < 400),
{direction} as (select target, node, cast(min(depth) as bigint) depth from walk_{direction} where node != target group by target, node)"""


def _first_item(graph: Graph) -> DataFrame:
    return graph.nodes.filter("kind = 'fn'").agg(F.min("id").alias("id"))


def _reach_of(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    graph = P.flow_graph(spark, sf_dir).stored()
    return graph, reach.impact_reach(graph, _first_item(graph))


@_query(_FLOW + _TARGET + _walk("upstream") + " select path, depth from upstream join nodes on id = node")
def radius_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.flow_graph(spark, sf_dir).stored()
    starts = _first_item(graph).select(F.col("id").alias("target"), F.col("id").alias("node"))
    return reach.reach(graph.uses(), starts, "upstream").join(graph.nodes.select(F.col("id").alias("node"), "path"), "node").select("path", "depth")


@_query(_FLOW + _TARGET + _walk("downstream") + " select path, depth from downstream join nodes on id = node")
def radius_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.flow_graph(spark, sf_dir).stored()
    starts = _first_item(graph).select(F.col("id").alias("target"), F.col("id").alias("node"))
    return reach.reach(graph.uses(), starts, "downstream").join(graph.nodes.select(F.col("id").alias("node"), "path"), "node").select("path", "depth")


@_query(_FLOW + _TARGET + _walk("upstream") + _walk("downstream") + " select id target, coalesce((select max(depth) from upstream), 0) max_upstream, coalesce((select max(depth) from downstream), 0) max_downstream from target")
def radius_max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, found = _reach_of(spark, sf_dir)
    return reach.max_depths(found, _first_item(graph))


_IMPACT = _CLOSURE + ", impacts as (select n.id, n.path, count(c.src) impact from nodes n left join closure c on c.dst = n.id and c.src != n.id group by n.id, n.path)"


@_query(_FLOW + _IMPACT + " select * from impacts")
def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.impacts(P.flow_graph(spark, sf_dir).stored())


@_query(_FLOW + _IMPACT + _DEGREES + " select row_number() over (order by impact desc, i.path, i.id) position, i.path, impact, class from impacts i join classes c on c.id = i.id order by 1 limit 10")
def ranking_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_nodes(P.flow_graph(spark, sf_dir).stored(), 10)


@_query(_FLOW + _IMPACT + _DEGREES + " select i.path from impacts i join classes c on c.id = i.id where class = 'leaf' and impact = 0 and split_part(i.path, '::', 3) in ('error', 'view')")
def behavioural_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.flow_graph(spark, sf_dir).stored()
    leaves = degrees.classification(graph).filter("class = 'leaf'").select("id")
    named = graph.nodes.filter(F.col("name").isin("error", "view")).select("id")
    return ranking.impacts(graph).filter("impact = 0").join(leaves, "id").join(named, "id").select("path")


# --- components and the matrix -----------------------------------------------------------------


@_query(_FLOW + _CLOSURE + " select id, label from parts")
def sccs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scc.components(P.flow_graph(spark, sf_dir).stored()).select("id", "label")


@_query(_FLOW + _CLOSURE + " select label, count(*) size, string_agg(path, ',' order by path) members from parts group by label having count(*) >= 2")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scc.cycles(scc.components(P.flow_graph(spark, sf_dir).stored())).withColumn("members", F.array_join("members", ","))


@_query(_MARKET + _CLOSURE + ", sizes as (select count(*) size from parts group by label having count(*) >= 2) select count(*) n_cycles, coalesce(max(size), 0) largest from sizes")
def cycle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scc.cycle_summary(scc.components(P.market_graph(spark, sf_dir).stored()))


_MARKET_MODULES = _MARKET + _MODULE_OF + """, crossing as (
  select a.module src, b.module dst from edges e join module_of a on a.id = e.src join module_of b on b.id = e.dst
  where relation = 'uses' and a.module != b.module)"""
_QUOTIENT = _MARKET_MODULES.replace("nodes as (", "items as (").replace("from nodes", "from items").replace("join nodes", "join items").replace("edges as (", "item_edges as (").replace("from edges", "from item_edges").replace("join edges", "join item_edges").replace("uses as (", "item_uses as (") + """,
nodes as (select id, path from items where kind in ('mod', 'crate')),
uses as (select distinct src, dst from crossing)"""


@_query(_QUOTIENT + _CLOSURE + " select distinct a.label src, b.label dst from uses join parts a on a.id = src join parts b on b.id = dst where a.label != b.label")
def condensation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotient = _quotient(spark, sf_dir)
    return scc.condensation(quotient, scc.components(quotient))


def _quotient(spark: SparkSession, sf_dir: str) -> Graph:
    graph = P.market_graph(spark, sf_dir).stored()
    return modules.module_graph(graph, modules.containing_modules(graph)).stored()


_ORDER = _CLOSURE + """, arrows as (select distinct a.label src, b.label dst from uses join parts a on a.id = src join parts b on b.id = dst where a.label != b.label),
kahn as (
  select cast([] as varchar[]) done
  union all
  select list_append(done, nxt) from (
    select done, (
      select min(p.label) from parts p where not list_contains(done, p.label)
      and not exists (select 1 from arrows a where a.dst = p.label and not list_contains(done, a.src))) nxt from kahn) s
  where nxt is not null),
full_order as (select done from kahn order by len(done) desc limit 1),
placed as (select label, list_position((select done from full_order), label) place, count(*) size from parts group by label)"""


@_query(_QUOTIENT + _ORDER + " select row_number() over (order by place, path) - 1 ordinal, path from parts join placed using (label)")
def dsm_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotient = _quotient(spark, sf_dir)
    return dsm_order(quotient, scc.components(quotient)).select("ordinal", "path")


@_query(_QUOTIENT + _ORDER + ", blocks as (select label, row_number() over (order by place) - 1 block from placed where size >= 2) select path, block from parts join blocks using (label)")
def dsm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotient = _quotient(spark, sf_dir)
    return dsm_order(quotient, scc.components(quotient)).filter("block is not null").select("path", "block")


# --- modules -----------------------------------------------------------------------------------


@_query(_TRADE + _MODULE_OF + " select id, module from module_of")
def module_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.containing_modules(P.trade_graph(spark, sf_dir).stored())


@_query(_MARKET_MODULES + " select distinct src, dst from crossing")
def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotient(spark, sf_dir).uses().select("src", "dst")


@_query(_MARKET + " select src, dst from edges join nodes a on a.id = src join nodes b on b.id = dst where relation = 'owns' and a.kind in ('mod', 'crate') and b.kind in ('mod', 'crate')")
def module_owns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotient(spark, sf_dir).owns().select("src", "dst")


@_query(_TRADE + _MODULE_OF + """, crossing as (
  select a.module src_module, b.module dst_module from edges e join module_of a on a.id = e.src join module_of b on b.id = e.dst
  where relation = 'uses' and a.module != b.module)
select src_module, dst_module, count(*) weight from crossing group by src_module, dst_module""")
def module_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir).stored()
    return modules.coupling_weights(graph, modules.containing_modules(graph))


def _module_walk(direction: str) -> str:
    near, far = ("dst", "src") if direction == "upstream" else ("src", "dst")
    return f""", walk_{direction} as (
  select module, id node from module_of union
  select w.module, u.{far} from walk_{direction} w join uses u on u.{near} = w.node)"""


@_query(_FLOW + _MODULE_OF + _module_walk("upstream") + _module_walk("downstream") + """
select distinct w.module, 'upstream' direction, m.module other from walk_upstream w join module_of m on m.id = w.node where m.module != w.module union all
select distinct w.module, 'downstream', m.module from walk_downstream w join module_of m on m.id = w.node where m.module != w.module""")
def module_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.flow_graph(spark, sf_dir).stored()
    return modules.module_radii(graph, modules.containing_modules(graph))


# --- identity ----------------------------------------------------------------------------------

_VERDICTS = """, copies as (select path, id, row_number() over (partition by path order by id) place, count(*) over (partition by path) copies from nodes),
pairs as (select path, copies, min(id) a, max(id) b from copies where copies > 1 and place <= 2 group by path, copies),
plain as (select distinct src, dst, relation from edges),
judged as (
  select p.*,
    (select count(*) from plain where (src = a and dst = b) or (src = b and dst = a)) shared,
    (select count(*) from plain where (src = a or dst = a) and not ((src = a and dst = b) or (src = b and dst = a))) only_a,
    (select count(*) from plain where (src = b or dst = b) and not ((src = a and dst = b) or (src = b and dst = a))) only_b
  from pairs p),
verdicts as (select *, case when shared = 0 and only_a > 0 and only_b > 0 then 'distinct' when shared > 0 and only_a = 0 and only_b = 0 then 'same_item' else 'undecided' end verdict from judged)"""


@_query(_CHAT + " select path, count(*) copies from nodes group by path having count(*) > 1")
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.collisions(P.chat_graph(spark, sf_dir))


@_query(_CHAT + _VERDICTS + " select path, a, b, copies, shared, only_a, only_b, verdict from verdicts")
def collision_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.verdicts(P.chat_graph(spark, sf_dir))


_RENAMED = _VERDICTS + """, named as (
  select n.*, v.verdict, v.a kept, row_number() over (partition by n.path order by id) place,
    count(*) over (partition by n.path, "trait") same_trait, count(*) over (partition by n.path, "trait", trait_ref) same_ref
  from nodes n left join verdicts v on v.path = n.path),
resolved as (
  select id, kept, verdict, case
    when verdict is distinct from 'distinct' then path
    when "trait" is not null and same_trait = 1 then regexp_replace(path, '::([^:]*)$', '::<' || "trait" || '>::\\1')
    when "trait" is not null and trait_ref is not null and same_ref = 1 then regexp_replace(path, '::([^:]*)$', '::<' || trait_ref || '>::\\1')
    else path || '#' || place end path
  from named)"""


@_query(_CHAT + _RENAMED + " select id, path from resolved where verdict is distinct from 'same_item' or id = kept")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(P.chat_graph(spark, sf_dir), skip_undecided=True).nodes.select("id", "path")


@_query(_CHAT + _RENAMED + """, moved as (select id, kept from resolved where verdict = 'same_item' and id != kept)
select distinct coalesce(a.kept, src) src, coalesce(b.kept, dst) dst, relation from edges left join moved a on a.id = src left join moved b on b.id = dst""")
def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(P.chat_graph(spark, sf_dir), skip_undecided=True).edges.select("src", "dst", "relation").distinct()


# --- workspace ---------------------------------------------------------------------------------

_CRATES = f"with nodes as ({P.CRATE_NODES}), edges as ({P.CRATE_EDGES})"
_CHOSEN = """, chosen as (
  select * from (select *, row_number() over (partition by path order by case when label = split_part(path, '::', 1) then 0 else 1 end, file is null, label, id) place from nodes) s where place = 1),
numbered as (select path, kind, row_number() over (order by path) - 1 new_id, label, file from chosen)"""


def _labelled(spark: SparkSession, sf_dir: str) -> Graph:
    nodes, edges = P.crates(spark, sf_dir)
    nodes = nodes.withColumn("position", F.when(F.col("file").isNotNull(), F.struct("file", F.lit(1).alias("start_line"), F.lit(9).alias("end_line")))).drop("file")
    graph = Graph.of(nodes, edges)
    # The edges are a part of what crates stored.
    return graph.with_nodes(materialize(graph.nodes, "labelled"))


@_query(_CRATES + _CHOSEN + " select new_id id, path, kind, file from numbered")
def union_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.unite(_labelled(spark, sf_dir)).graph.nodes.select("id", "path", "kind", F.col("position.file").alias("file"))


@_query(_CRATES + _CHOSEN + """
select distinct s.new_id src, d.new_id dst, e.relation, e.uses_kind from edges e
join nodes a on a.label = e.label and a.id = e.src join nodes b on b.label = e.label and b.id = e.dst
join numbered s on s.path = a.path join numbered d on d.path = b.path""")
def union_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.unite(_labelled(spark, sf_dir)).graph.edges.select("src", "dst", "relation", "uses_kind")


@_query(_CRATES + """ select path, string_agg(distinct label, ',' order by label) referenced_by from nodes
where split_part(path, '::', 1) in (select label from nodes) group by path having count(*) filter (where label = split_part(path, '::', 1)) = 0""")
def ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.ghosts(_labelled(spark, sf_dir)).withColumn("referenced_by", F.array_join("referenced_by", ","))


# --- diff --------------------------------------------------------------------------------------

_DIFF = f"with recursive nodes as ({P.PLACED_NODES}), edges as ({P.FLOW_EDGES}), uses as (select distinct src, dst from edges where relation = 'uses'), hunks as ({P.HUNKS}), files as ({P.CHANGED_FILES}), dirs as ({P.MEMBER_DIRS})"
_TOUCHED = ", touched as (select distinct id, path from nodes n join hunks h on (n.file = h.file or ends_with(n.file, '/' || h.file)) and n.start_line <= h.\"end\" and h.\"start\" <= n.end_line)"
_ALL_REACH = _TOUCHED + ", target as (select id from touched)" + _walk("upstream") + _walk("downstream") + ", every as (select target, 'upstream' direction, node, depth from upstream union all select target, 'downstream', node, depth from downstream)"


def _placed(spark: SparkSession, sf_dir: str) -> Graph:
    nodes = P.select(spark, sf_dir, P.PLACED_NODES)
    nodes = nodes.withColumn("position", F.struct("file", "start_line", "end_line")).drop("file", "start_line", "end_line")
    return Graph.of(nodes, P.select(spark, sf_dir, P.FLOW_EDGES)).stored()


def _touched_reach(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    graph = _placed(spark, sf_dir)
    return graph, diffing.touched_radius(graph, diffing.touched_nodes(graph, P.select(spark, sf_dir, P.HUNKS)))


@_query(_DIFF + _TOUCHED + " select * from touched")
def touched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.touched_nodes(_placed(spark, sf_dir), P.select(spark, sf_dir, P.HUNKS))


@_query(_DIFF + """ select distinct file, case
  when exists (select 1 from nodes n where n.file = f.file or ends_with(n.file, '/' || f.file)) then 'linked'
  when ends_with(file, '.rs') and exists (select 1 from dirs where file = dir or starts_with(file, dir || '/')) then 'loose' else 'non_source' end bucket
from files f where origin = 'untracked'""")
def untracked_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.untracked_census(_placed(spark, sf_dir), P.select(spark, sf_dir, P.CHANGED_FILES), P.select(spark, sf_dir, P.MEMBER_DIRS))


@_query(_DIFF + _ALL_REACH + " select target, direction, count(*) n, max(depth) deepest from every group by target, direction")
def touched_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _touched_reach(spark, sf_dir)
    return found.groupBy("target", "direction").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@_query(_DIFF + _ALL_REACH + " select direction, node, min(depth) depth from every group by direction, node")
def combined_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _placed(spark, sf_dir)
    return reach.combined_radius(graph, diffing.touched_nodes(graph, P.select(spark, sf_dir, P.HUNKS)))


@_query(_DIFF + _ALL_REACH + " select split_part(path, '::', 1) crate, count(*) n from (select distinct node from every where direction = 'upstream') e join nodes on id = node group by 1")
def impact_by_crate(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _placed(spark, sf_dir)
    touched = diffing.touched_nodes(graph, P.select(spark, sf_dir, P.HUNKS))
    return diffing.by_crate(graph.nodes.join(reach.combined_reach(graph.uses(), touched, "upstream").withColumnRenamed("node", "id"), "id"))


@_query("""select event_id diff_id, concat('f', cast(user_id as string), '.rs') file, cast(event_id % 50 as int) "start", cast(event_id % 50 + event_id % 4 - 1 as int) "end"
from {events} where event_id % 50 > 0 and event_id % 4 > 0 union all
select event_id, 'g.rs', 7, 7 from {events} where event_id % 3 != 0""")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.lit("+++ b/f"), F.col("user_id").cast("string"), F.lit(".rs\n@@ -3,2 +"), (F.col("event_id") % 50).cast("string"), F.lit(","), (F.col("event_id") % 4).cast("string"), F.lit(" @@ fn x\n+++ "))
    text = F.concat(line, F.when(F.col("event_id") % 3 == 0, "/dev/null").otherwise("b/g.rs"), F.lit("\n@@ -1 +7 @@"))
    return parse_diff(events.select(F.col("event_id").alias("diff_id"), text.alias("text")))


@_query("select doc_id, length(text) - length(replace(text, chr(10), '')) + case when text != '' and not ends_with(text, chr(10)) then 1 else 0 end n_lines from {documents}")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", line_count(F.col("text")).cast("long").alias("n_lines"))


# --- comparison --------------------------------------------------------------------------------

_MOVED = "cast((case when n_nationkey % 7 = 0 then (n_regionkey + 1) % 5 else n_regionkey end) as string)"
_AFTER_NODES = P.MARKET_NODES.replace("tpch", "newtp").replace("cast(n_regionkey as string)", _MOVED).replace("cast(c_custkey as string)", "cast(c_custkey % 1000 as string)").replace("where id < 10000000", "where id < 10000000 and id % 9 != 4")
_AFTER_EDGES = "select * from (" + P.MARKET_EDGES + ") e where src % 3 != 0 and src % 9 != 4 and dst % 9 != 4"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph]:
    after = Graph.of(P.select(spark, sf_dir, _AFTER_NODES), P.select(spark, sf_dir, _AFTER_EDGES), "newtp")
    return P.market_graph(spark, sf_dir).stored(), after.stored()


def _module_frames(graph: Graph) -> tuple[DataFrame, DataFrame]:
    names = graph.nodes.filter("kind in ('mod', 'crate')").select("id", "path")
    weights = modules.coupling_weights(graph, modules.containing_modules(graph))
    named = weights.join(names.select(F.col("id").alias("src_module"), F.col("path").alias("src")), "src_module").join(names.select(F.col("id").alias("dst_module"), F.col("path").alias("dst")), "dst_module")
    return names, named.select("src", "dst", "weight")


_KEY = "case when instr(path, '::') > 0 then substr(path, instr(path, '::') + 2) else '' end"
_SIDES = f"with recursive before_nodes as ({P.MARKET_NODES}), before_edges as ({P.MARKET_EDGES}), after_nodes as ({_AFTER_NODES}), after_edges as ({_AFTER_EDGES})"


def _side_sql(side: str) -> str:
    return f""", {side}_climb as (
  select id, id above, kind in ('mod', 'crate') done from {side}_nodes union all
  select c.id, e.src, n.kind in ('mod', 'crate') from {side}_climb c join {side}_edges e on e.dst = c.above and e.relation = 'owns' join {side}_nodes n on n.id = e.src where not c.done),
{side}_modules as (select {_KEY} key, max(path) path from {side}_nodes where kind in ('mod', 'crate') group by 1),
{side}_deps as (
  select {_KEY.replace('path', 's.path')} src_key, {_KEY.replace('path', 'd.path')} dst_key, s.path src, d.path dst, count(*) weight from {side}_edges e
  join {side}_climb a on a.id = e.src and a.done join {side}_climb b on b.id = e.dst and b.done and b.above != a.above
  join {side}_nodes s on s.id = a.above join {side}_nodes d on d.id = b.above
  where relation = 'uses' group by s.path, d.path)"""


_COMPARED = _SIDES + _side_sql("before") + _side_sql("after") + """, pairs as (
  select coalesce(b.key, a.key) key, b.path path_before, a.path path_after from before_modules b full join after_modules a on a.key = b.key),
paired as (select key from pairs where path_before is not null and path_after is not null),
deltas as (
  select coalesce(b.src_key, a.src_key) src_key, coalesce(b.dst_key, a.dst_key) dst_key, b.weight weight_before, a.weight weight_after
  from (select * from before_deps where src_key in (from paired) and dst_key in (from paired)) b
  full join (select * from after_deps where src_key in (from paired) and dst_key in (from paired)) a on a.src_key = b.src_key and a.dst_key = b.dst_key)"""


@_query(_COMPARED + " select * from pairs")
def module_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    (a, _), (b, _) = (_module_frames(g) for g in _sides(spark, sf_dir))
    return compare.module_pairs(a, b, "normalized")


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    (a, da), (b, db) = (_module_frames(g) for g in _sides(spark, sf_dir))
    return compare.edge_deltas(da, db, compare.module_pairs(a, b, "normalized"), "normalized")


@_query(_COMPARED + " select * from deltas")
def edge_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir)


@_query(_COMPARED + " select *, weight_after - weight_before change from deltas where weight_before != weight_after order by abs(weight_after - weight_before) desc, src_key, dst_key limit 10")
def top_weight_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.top_weight_deltas(_deltas(spark, sf_dir))


_ITEMS = _SIDES + "".join(f""", {side}_items as (
  select kind, '' "trait", split_part(path, '::', -1) name, list_sort(list(path)) paths from {side}_nodes where kind not in ('mod', 'crate', 'builtin') group by 1, 2, 3)""" for side in ("before", "after")) + """, items as (
  select coalesce(b.kind, a.kind) kind, coalesce(b."trait", a."trait") "trait", coalesce(b.name, a.name) name, b.paths before, a.paths after,
    case when a.paths is null then 'only_before' when b.paths is null then 'only_after' when len(a.paths) = 1 and len(b.paths) = 1 then 'paired' else 'ambiguous' end status
  from before_items b full join after_items a on a.kind = b.kind and a."trait" = b."trait" and a.name = b.name)"""


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of keys, items before, items after)."""
    before, after = (compare.item_keys(g) for g in _sides(spark, sf_dir))
    return compare.item_pairs(before, after), before, after


@_query(_ITEMS + " select kind, name, before[1] path_before, after[1] path_after from items where status = 'paired'")
def item_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)[0].filter("status = 'paired'").select("kind", "name", F.col("before").alias("path_before"), F.col("after").alias("path_after"))


@_query(_ITEMS + " select kind, name, array_to_string(before, ',') before, array_to_string(after, ',') after from items where status = 'ambiguous'")
def item_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For readers: the paths of a key in one text. ambiguous_items has them as rows."""
    paths = lambda s: F.array_join(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("path")))), ",").alias(s)
    return compare.items_with(*_items(spark, sf_dir), "ambiguous").groupBy("kind", "trait", "name").agg(paths("before"), paths("after")).drop("trait")


@_query(_ITEMS + " select kind, name, 'before' side, unnest(before) path from items where status = 'ambiguous' union all select kind, name, 'after', unnest(after) from items where status = 'ambiguous'")
def ambiguous_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.items_with(*_items(spark, sf_dir), "ambiguous").select("kind", "name", "side", "path")


@_query(_ITEMS + """ select case when status = 'only_before' then 'before' else 'after' end side, kind, "trait", name, unnest(coalesce(before, after)) path from items where status in ('only_before', 'only_after')""")
def item_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.unpaired_items(*_items(spark, sf_dir))


@_query(_ITEMS + " select kind, count(*) n from items where status = 'paired' group by kind")
def paired_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)[0].filter("status = 'paired'").groupBy("kind").agg(F.count("*").alias("n"))


@_query(_ITEMS + " select count(*) filter (where status = 'paired') n_paired, count(*) filter (where status = 'ambiguous') n_ambiguous, count(*) filter (where status = 'only_before') n_only_before, count(*) filter (where status = 'only_after') n_only_after from items")
def key_discriminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.key_census(*(compare.item_keys(g) for g in _sides(spark, sf_dir)))


def _depth_sql_each(name: str) -> str:
    """(path, direction, n): how far each path of target reaches over {name}_nodes and {name}_edges."""
    near = {"upstream": ("dst", "src"), "downstream": ("src", "dst")}
    walks = "".join(f""", {name}_{d} as (
  select n.path target, n.id node from {name}_nodes n join target on target.path = n.path union
  select w.target, e.{far} from {name}_{d} w join {name}_edges e on e.{a} = w.node)""" for d, (a, far) in near.items())
    counts = " union all ".join(f"select target path, '{d}' direction, count(*) - 1 n from {name}_{d} group by target" for d in near)
    return walks + f", {name}_sizes as ({counts})"
