"""Queries over stores, catalogues in bulk, whole analyses and their texts, with their SQL."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow import queries as Q
from undertow.graph import Graph
from undertow.operators import compare, diffing, measures, modules, reach, workspace
from undertow.operators.degrees import classification
from undertow.plans import analyses
from undertow.render import comparison_lines, comparison_text, diff_text, folded, folded_matrix, radii_by_index, radius_text, ranking_text, structure_text
from undertow.runtime import shared_dir
from undertow.schema import MODULE_KINDS
from undertow.sources import catalog
from undertow.sources import projections as P
from undertow.sources.diff_text import parse_diff_lines, untracked_ranges
from undertow.sources.long_json import read_long_graph
from undertow.sources.store import GraphStore, crate_keys

QUERIES: dict[str, Q.Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f: Q.Query) -> Q.Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = P.plain_sql(sql)
        return f

    return register


def _lines(spark: SparkSession, text: str) -> DataFrame:
    """The lines of a rendered text, which somebody reads, as (n, line)."""
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "n int, line string")


# --- one long document ---------------------------------------------------------------------------


def _orders_as_one_document(spark: SparkSession, sf_dir: str) -> Graph:
    """All orders, each owning its lines, written as one JSON document, and read back in blocks of 1 MB.

    Many tasks write it, each a piece: a range of its text in order."""
    order = F.col("l_orderkey") * 100
    line = order + F.col("l_linenumber")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    path = F.concat(F.lit("o::O"), F.col("l_orderkey").cast("string"))
    node = lambda i, p, kind: F.to_json(F.struct(i.alias("id"), p.alias("path"), F.lit('},{"id":').alias("name"), F.lit(kind).alias("kind"), F.lit("pub").alias("visibility")))
    edge = F.to_json(F.struct(order.alias("id_from"), line.alias("id_to"), F.lit("owns").alias("relation")))
    root = '{"id":-1,"path":"o","name":"o","kind":"crate","visibility":"pub"}'
    frame = spark.createDataFrame([(0, 0, f'{{"crate":"o","nodes":[{root}'), (2, 0, '],"edges":[{"id_from":-1,"id_to":-1,"relation":"uses"}'), (4, 0, "]}")], "part int, at long, text string")
    rows = lines.select(F.lit(1).alias("part"), line.alias("at"), "l_orderkey", "l_linenumber").unionByName(lines.select(F.lit(3).alias("part"), line.alias("at"), "l_orderkey", "l_linenumber"))
    rows = rows.unionByName(lines.select("l_orderkey").distinct().select(F.lit(1).alias("part"), order.alias("at"), "l_orderkey"), allowMissingColumns=True)
    rows = rows.unionByName(frame, allowMissingColumns=True).repartitionByRange("part", "at").sortWithinPartitions("part", "at")
    # Keys travel, and become text where they are written.
    item = F.when(F.col("part") == 3, edge).when(F.col("l_linenumber").isNull(), node(order, path, "mod"))
    item = item.otherwise(node(line, F.concat(path, F.lit("::L"), F.col("l_linenumber").cast("string")), "fn"))
    folder = f"{shared_dir(spark)}/long-document-{uuid4().hex}"
    rows.select(F.coalesce("text", F.concat(F.lit(","), item)).alias("text")).write.text(folder)
    return read_long_graph(spark, folder, block=1 << 20, in_pieces=True)


@_query("""select cast(-1 as bigint) id, 'o' path, 'crate' kind union all
select distinct l_orderkey * 100, concat('o::O', cast(l_orderkey as varchar)), 'mod' from {lineitem} union all
select distinct l_orderkey * 100 + l_linenumber, concat('o::O', cast(l_orderkey as varchar), '::L', cast(l_linenumber as varchar)), 'fn' from {lineitem}""")
def long_document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_as_one_document(spark, sf_dir).nodes.select("id", "path", "kind")


@_query("""select cast(0 as bigint) edge_seq, cast(-1 as bigint) src, cast(-1 as bigint) dst, 'uses' relation union all
select row_number() over (order by l_orderkey, l_linenumber), l_orderkey * 100, l_orderkey * 100 + l_linenumber, 'owns' from (select distinct l_orderkey, l_linenumber from {lineitem}) d""")
def long_document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges with their places in the document."""
    return _orders_as_one_document(spark, sf_dir).edges.select("edge_seq", "src", "dst", "relation")


# --- catalogues, diffs and stores ----------------------------------------------------------------


@_query("select concat('p', cast(s_suppkey as varchar)) name, concat('/w/', cast(s_suppkey as varchar), '/Cargo.toml') manifest_path, case s_suppkey % 3 when 0 then 'lib' when 1 then concat('bin:b', cast(s_suppkey as varchar)) end target from {supplier}")
def metadata_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured metadata, one document for each supplier, written and read again."""
    key = F.col("s_suppkey")
    name = F.concat(F.lit("p"), key.cast("string"))
    target = lambda n, kind: F.struct(n.alias("name"), F.array(F.lit(kind)).alias("kind"))
    binary = target(F.concat(F.lit("b"), key.cast("string")), "bin")
    targets = F.when(key % 3 == 0, F.array(binary, target(name, "proc-macro"))).when(key % 3 == 1, F.array(target(name, "test"), binary)).otherwise(F.array(binary, binary))
    package = F.struct(name.alias("name"), F.concat(F.lit("/w/"), key.cast("string"), F.lit("/Cargo.toml")).alias("manifest_path"), targets.alias("targets"))
    folder = f"{shared_dir(spark)}/metadata-{uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.array(package).alias("packages"), F.lit(1).alias("version")).write.json(folder)
    return catalog.read_metadata(spark, folder, lines=True).select("name", "manifest_path", catalog.chosen_target(F.col("targets")).alias("target"))


@_query("select c_custkey root, case when c_custkey % 5 in (0, 1, 4) then 'package' when c_custkey % 5 = 2 then 'workspace' end nature from {customer}")
def manifest_natures(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ("[workspace]\nmembers = []\n\n[package]\nname = 'x'", "[package.metadata]\nx = 1", "  [workspace.dependencies]", "[dependencies]\npackage = 1\n# [package]", "package.name = 'x'\n[lib]")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("root"), F.get(F.array(*map(F.lit, texts)), (F.col("c_custkey") % 5).cast("int")).alias("text"))
    return catalog.root_natures(rows)


@_query("""select concat('d', cast(doc_id as varchar), '.rs') file, 1 "start", cast(n as integer) "end" from (
  select doc_id, length(text) - length(replace(text, chr(10), '')) + case when text != '' and not ends_with(text, chr(10)) then 1 else 0 end n from {documents}) l where n > 0""")
def untracked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return untracked_ranges(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("file"), "text"))


@_query("""select case when l_orderkey % 2 = 0 then 'even' else 'odd' end diff_id, concat('o', cast(l_orderkey as varchar), '.rs') file, cast(l_partkey as integer) "start", cast(l_partkey + l_linenumber % 3 - 1 as integer) "end"
from {lineitem} where l_linenumber % 3 > 0 and l_partkey > 0 and l_orderkey % 7 != 0""")
def two_long_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two diffs, of a file for each order and a hunk for each of its lines, dealt over all tasks."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.col("l_orderkey").cast("string")
    where = F.when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd").alias("diff_id")
    file = F.when(F.col("l_orderkey") % 7 == 0, "/dev/null").otherwise(F.concat(F.lit("b/o"), key, F.lit(".rs")))
    heads = lines.select(where, "l_orderkey", F.lit(0).alias("at"), F.concat(F.lit("+++ "), file).alias("line")).distinct()
    hunks = lines.select(where, "l_orderkey", F.col("l_linenumber").cast("int").alias("at"), F.concat(F.lit("@@ -1 +"), F.col("l_partkey").cast("string"), F.lit(","), (F.col("l_linenumber") % 3).cast("string"), F.lit(" @@")).alias("line"))
    return parse_diff_lines(heads.unionByName(hunks), ["l_orderkey", "at"])


_CRATE_FILES = """
  select concat('c', cast(doc_id % 50 as string), case when doc_id % 4 = 0 then '/inner' else '' end, '/src/f', cast(doc_id as string), case when doc_id % 9 = 0 then '.txt' else '.rs' end) path, text content from {documents} union all
  select distinct concat('c', cast(doc_id % 50 as string), '/Cargo.toml'), concat('[package] ', cast(doc_id % 50 as string)) from {documents} union all
  select distinct concat('c', cast(doc_id % 50 as string), '/inner/Cargo.toml'), 'inner' from {documents} where doc_id % 8 = 0"""


@_query(f"with files as ({_CRATE_FILES})" + """, crates as (select left(path, length(path) - 11) dir, sha256(content) manifest from files where ends_with(path, '/Cargo.toml')),
placed as (
  select f.path, sha256(f.content) digest, max_by(c.dir, length(c.dir)) dir from files f join crates c on starts_with(f.path, c.dir || '/') where ends_with(f.path, '.rs') group by 1, 2),
lists as (select dir, string_agg(substr(path, length(dir) + 2) || ':' || digest, chr(10) order by substr(path, length(dir) + 2), digest) listing from placed group by dir)
select c.dir, sha256('sources:' || strlen(coalesce(listing, '')) || ':' || coalesce(listing, '') || 'manifest:64:' || manifest || 'lock:5:v = 4' || 'toolchain:6:stable') "key" from crates c left join lists l on l.dir = c.dir""")
def keys_of_crates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crate_keys(P.select(spark, sf_dir, _CRATE_FILES), lock="v = 4", toolchain="stable")


@_query(f"with nodes as ({P.CRATE_NODES}) select label, id, path from nodes where label != 'R2' or id % 5 != 0")
def stored_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crates stored one by one; one of them changes, and a change of another breaks off before it is published."""
    every = Q._labelled(spark, sf_dir)
    labels = sorted(r["label"] for r in every.nodes.select("label").distinct().collect())  # one for each region
    of = lambda label: Graph(every.nodes.filter(F.col("label") == label).drop("label"), every.edges.filter(F.col("label") == label).drop("label"), label)
    store = GraphStore(spark, f"{shared_dir(spark)}/store-{uuid4().hex}")
    store.update(dict.fromkeys(labels, "first"), of)
    store.write_version(of(labels[0]).with_nodes(every.nodes.limit(0).drop("label")), labels[0])
    store.update(dict.fromkeys(labels, "first") | {"R2": "second"}, lambda label: of(label).with_nodes(of(label).nodes.filter("id % 5 != 0")))
    return store.united(labels).nodes.select("label", "id", "path")


_LISTED = """
  select case c_custkey % 5 when 0 then concat('u', cast(c_custkey as string), '/.rs') when 1 then concat('u', cast(c_custkey as string), '/x.rs') when 2 then concat('v/u', cast(c_custkey as string), '.rs') when 3 then concat('u', cast(c_custkey as string), '/a.b.rs') else '.rs' end file,
    'untracked' origin from {customer}"""
_HOMES = "select concat('u', cast(c_custkey as string)) dir from {customer} where c_custkey % 3 != 0"


@_query(f"with files as ({_LISTED}), dirs as ({_HOMES})" + " select distinct file, case when ends_with(file, '.rs') and not ends_with(file, '/.rs') and file != '.rs' and split_part(file, '/', 1) in (select dir from dirs) and contains(file, '/') then 'loose' else 'non_source' end bucket from files")
def loose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a stem are no sources."""
    return diffing.untracked_census(Q._placed(spark, sf_dir), P.select(spark, sf_dir, _LISTED), P.select(spark, sf_dir, _HOMES))


# --- whole analyses ------------------------------------------------------------------------------


@_query(Q._CRATES + Q._CHOSEN + " select 'node' part, path \"value\" from numbered union all select 'failure', 'twins' union all select 'ghost', path from nodes where split_part(path, '::', 1) in (select label from nodes) group by path having count(*) filter (where label = split_part(path, '::', 1)) = 0")
def built_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each crate resolved and all united; one whose copies nothing tells apart is reported and left out."""
    every = Q._labelled(spark, sf_dir)
    labels = sorted(r["label"] for r in every.nodes.select("label").distinct().collect())
    graphs = {k: Graph(every.nodes.filter(F.col("label") == k).drop("label"), every.edges.filter(F.col("label") == k).drop("label"), k) for k in labels}
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    graphs["twins"] = Graph.of(nations.select(F.col("n_nationkey").cast("long").alias("id"), F.lit("twins::x").alias("path"), F.lit("fn").alias("kind")), every.edges.drop("label").limit(0), "twins")
    built = analyses.build_workspace(graphs)
    part = lambda name, df, c: df.select(F.lit(name).alias("part"), F.col(c).alias("value"))
    return part("node", built.graph.nodes, "path").unionByName(part("failure", built.failures, "label")).unionByName(part("ghost", built.ghosts, "path"))


#: Two sides of which a crate belongs to somebody else.
_OLD_NODES = P.MARKET_NODES + " union all select 50000000 + p_partkey, concat('vendor::P', cast(p_partkey as string)), 'fn' from {part}"
_NEW_NODES = Q._AFTER_NODES.replace("newtp", "tpch") + " union all select 60000000 + s_suppkey, concat('other-vendor::S', cast(s_suppkey as string)), 'fn' from {supplier}"
_FULL = Q._COMPARED.replace(Q._KEY, "path").replace(Q._KEY.replace("path", "s.path"), "s.path").replace(Q._KEY.replace("path", "d.path"), "d.path").replace("newtp", "tpch")


def _sides(spark: SparkSession, sf_dir: str) -> analyses.Comparison:
    graphs = [Graph.of(P.select(spark, sf_dir, n), P.select(spark, sf_dir, e)).stored() for n, e in ((_OLD_NODES, P.MARKET_EDGES), (_NEW_NODES, Q._AFTER_EDGES))]
    members = spark.createDataFrame([("tpch",)], "name string")
    return analyses.analyse_comparison(*graphs, natures=("workspace", "package"), members=(members, members))


@_query(_FULL + """
select 'module' part, key "key", path_before "before", path_after "after" from pairs union all
select 'dependency', src_key || ' ' || dst_key, cast(weight_before as varchar), cast(weight_after as varchar) from deltas union all
select 'third party', null, (select cast(count(*) as varchar) from {part}), (select cast(count(*) as varchar) from {supplier}) union all
select 'mode', 'full_path', 'workspace', 'package'""")
def whole_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full paths pair the modules, as one root is a workspace; other people's crates are left out and counted."""
    found = _sides(spark, sf_dir)
    row = lambda df, part, key, a, b: df.select(F.lit(part).alias("part"), key.alias("key"), a.cast("string").alias("before"), b.cast("string").alias("after"))
    out = row(found.pairs, "module", F.col("key"), F.col("path_before"), F.col("path_after"))
    out = out.unionByName(row(found.deltas, "dependency", F.concat_ws(" ", "src_key", "dst_key"), F.col("weight_before"), F.col("weight_after")))
    facts = [("third party", None, *map(str, found.removed_third_party)), ("mode", found.mode, *found.natures)]
    return out.unionByName(spark.createDataFrame(facts, "part string, key string, before string, after string"))


@_query(Q._SIDES.replace("newtp", "tpch") + "".join(f""", {side}_items as (select kind, split_part(path, '::', -1) name, path from {side}_nodes where kind not in ('mod', 'crate'))""" for side in ("before", "after")) + """
select 'only_before' part, '{"side":"before","kind":"' || kind || '","trait":"","name":"' || name || '","path":"' || path || '"}' "value" from before_items b where not exists (select 1 from after_items a where a.kind = b.kind and a.name = b.name) union all
select 'only_after', '{"side":"after","kind":"' || kind || '","trait":"","name":"' || name || '","path":"' || path || '"}' from after_items a where not exists (select 1 from before_items b where a.kind = b.kind and a.name = b.name)""")
def comparison_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of one side as JSON, one on each line."""
    return comparison_lines(_sides(spark, sf_dir)).filter("part in ('only_before', 'only_after')")


_DEPENDED = Q._QUOTIENT + Q._ORDER + """, weights as (
  select s.path src, d.path dst, count(*) weight from item_edges e join module_of a on a.id = e.src join module_of b on b.id = e.dst
  join items s on s.id = a.module join items d on d.id = b.module where relation = 'uses' and a.module != b.module group by s.path, d.path),
ordered as (select row_number() over (order by place, path) - 1 ordinal, path, label, count(*) over (partition by label) size from parts join placed using (label))"""


def _structure(spark: SparkSession, sf_dir: str) -> analyses.Structure:
    return analyses.structure_of(P.market_graph(spark, sf_dir))


@_query(_DEPENDED + """
select 'dependency' part, src a, dst b, weight n from weights union all
select 'order', path, null, ordinal from ordered union all
select 'cycle', label, null, size from ordered where size > 1 group by label, size""")
def whole_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _structure(spark, sf_dir)
    row = lambda df, part, a, b, n: df.select(F.lit(part).alias("part"), a.alias("a"), b.cast("string").alias("b"), n.cast("long").alias("n"))
    out = row(found.dependencies, "dependency", F.col("src"), F.col("dst"), F.col("weight"))
    out = out.unionByName(row(found.order, "order", F.col("path"), F.lit(None), F.col("ordinal")))
    return out.unionByName(row(found.cycles, "cycle", F.col("label"), F.lit(None), F.col("size")))


@_query(_DEPENDED + """, rows as (
  select 1 block, '' k, 'cycles:' line union all
  select 2, label, '  ' || string_agg(path, ', ' order by path) from ordered where size > 1 group by label union all
  select 3, '', 'dependencies:' union all
  select 4, src || chr(1) || dst, '  ' || src || ' -> ' || dst || ' (' || weight || ')' from weights union all
  select 5, '', 'order:' union all
  select 6, lpad(cast(ordinal as varchar), 9, '0'), '  ' || case when size > 1 then '#' else ' ' end || ' ' || path from ordered)
select cast(row_number() over (order by block, k) as integer) n, line from rows""")
def structure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, structure_text(_structure(spark, sf_dir)))


@_query(_DEPENDED + """, cells as (
  select i.ordinal i, j.ordinal j, weight from weights join ordered i on i.path = src join ordered j on j.path = dst),
shown as (select ordinal, path, case when path = 'tpch::R1' or path like 'tpch::R1::%' then 'tpch::R1' when path = 'tpch::R3' or path like 'tpch::R3::%' then 'tpch::R3' else path end shown from ordered),
rows as (select shown, row_number() over (order by min(ordinal)) - 1 place from shown group by shown)
select a.place i, b.place j, cast(sum(weight) as bigint) weight from cells c join shown s on s.ordinal = c.i join shown d on d.ordinal = c.j join rows a on a.shown = s.shown join rows b on b.shown = d.shown where a.place != b.place group by a.place, b.place""")
def matrix_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix with two regions closed."""
    closed = spark.createDataFrame([("tpch::R1",), ("tpch::R3",), ("tpch::R3::N4",)], "path string")
    return folded_matrix(_structure(spark, sf_dir), closed)


@_query(Q._TRADE + Q._MODULE_OF + """, weights as (
  select s.path src, d.path dst, count(*) weight from edges e join module_of a on a.id = e.src join module_of b on b.id = e.dst
  join nodes s on s.id = a.module join nodes d on d.id = b.module where relation = 'uses' and a.module != b.module group by s.path, d.path),
folds as (select depth, array_to_string(list_slice(string_split(src, '::'), 1, depth), '::') src, array_to_string(list_slice(string_split(dst, '::'), 1, depth), '::') dst, weight from weights, (select unnest([1, 2, 3]) depth) d)
select depth, src, dst, cast(sum(weight) as bigint) weight from folds where src != dst group by all""")
def folds_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights between the modules of the trade at every depth of folding."""
    graph = P.trade_graph(spark, sf_dir).stored()
    names = graph.nodes.filter(F.col("kind").isin(*MODULE_KINDS)).select("id", "path")
    weights = modules.coupling_weights(graph, modules.containing_modules(graph))
    weights = weights.join(names.withColumnsRenamed({"id": "src_module", "path": "src"}), "src_module").join(names.withColumnsRenamed({"id": "dst_module", "path": "dst"}), "dst_module").select("src", "dst", "weight")
    return reduce(DataFrame.unionByName, [folded(weights, d).withColumn("depth", F.lit(d)) for d in (1, 2, 3)])


_FLOW_RADII = Q._FLOW + Q._MODULE_OF + Q._module_walk("downstream")


@_query(Q._QUOTIENT + Q._ORDER + ", ordered as (select row_number() over (order by place, path) - 1 ordinal, path, id from parts join placed using (label))" + """, walk as (
  select module, id node from module_of union select w.module, u.dst from walk w join item_uses u on u.src = w.node),
met as (select distinct w.module, m.module other from walk w join module_of m on m.id = w.node where m.module != w.module)
select a.ordinal, 'downstream' direction, string_agg(cast(b.ordinal as varchar), ',' order by b.ordinal) others from met join ordered a on a.id = met.module join ordered b on b.id = met.other group by a.ordinal union all
select b.ordinal, 'upstream', string_agg(cast(a.ordinal as varchar), ',' order by a.ordinal) from met join ordered a on a.id = met.module join ordered b on b.id = met.other group by b.ordinal""")
def radii_in_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module radii as places in the matrix, for a viewer."""
    return radii_by_index(_structure(spark, sf_dir)).withColumn("others", F.array_join(F.transform("others", lambda x: x.cast("string")), ","))


@_query(Q._FLOW + Q._IMPACT + Q._DEGREES + """, ranked as (select row_number() over (order by impact desc, i.path, i.id) position, i.path, impact, class from impacts i join classes c on c.id = i.id)
select cast(position as integer) n, lpad(cast(position as varchar), 4, ' ') || '  ' || lpad(cast(impact as varchar), 8, ' ') || '  ' || rpad(class, 12, ' ') || '  ' || path line from ranked where position <= 25""")
def ranking_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, ranking_text(analyses.analyse_ranking(P.flow_graph(spark, sf_dir), top=25, scope="own_code")))


@_query(Q._TRADE + Q._DEGREES + ", target as (select cast(2000003 as bigint) id)" + Q._walk("upstream") + Q._walk("downstream") + """, rows as (
  select 1 block, '' k, 'target' || chr(9) || path line from classes where id = 2000003 union all
  select 2, '', 'class' || chr(9) || class from classes where id = 2000003 union all
  select 3, '', 'direct' || chr(9) || uses_in from classes where id = 2000003 union all
  select 4, '', 'transitive' || chr(9) || count(*) from upstream union all
  select 5, '', 'depends on' || chr(9) || count(*) from downstream union all
  select 6, path, '  ' || path from upstream join nodes on id = node)
select cast(row_number() over (order by block, k) as integer) n, line from rows""")
def radius_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, radius_text(*analyses.analyse_radius(P.trade_graph(spark, sf_dir), node_id=2000003), verbose=True))


@_query(Q._DIFF + Q._ALL_REACH + """, files_of as (
  select distinct file, case when exists (select 1 from nodes n where n.file = f.file or ends_with(n.file, '/' || f.file)) then 'linked'
    when ends_with(file, '.rs') and exists (select 1 from dirs where file = dir or starts_with(file, dir || '/')) then 'loose' else 'non_source' end bucket from files f where origin = 'untracked'),
buckets as (select b.bucket, b.k, count(file) n, string_agg(split_part(file, '/', -1), ', ' order by split_part(file, '/', -1)) names from (values ('linked', 1), ('loose', 2), ('non_source', 3)) b(bucket, k) left join files_of f on f.bucket = b.bucket group by b.bucket, b.k),
rows as (
  select 1 block, lpad(cast(row_number() over (order by path, id) as varchar), 9, '0') k, path line from touched union all
  select 2, cast(k as varchar), 'untracked, ' || replace(bucket, '_', ' ') || ': ' || n || case when n > 0 then ' (' || names || ')' else '' end from buckets)
select cast(row_number() over (order by block, k) as integer) n, line from rows""")
def diff_item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of a diff that lists every touched path, and its foot."""
    graph = Q._placed(spark, sf_dir)
    touched = diffing.touched_nodes(graph, P.select(spark, sf_dir, P.HUNKS))
    census = diffing.untracked_census(graph, P.select(spark, sf_dir, P.CHANGED_FILES), P.select(spark, sf_dir, P.MEMBER_DIRS))
    return _lines(spark, diff_text(touched, census, touched.limit(0), "item"))


@_query(Q._DIFF + Q._ALL_REACH + """, sizes as (select target, count(*) filter (where direction = 'upstream') upstream, count(*) filter (where direction = 'downstream') downstream from every group by target)
select t.id, t.path, case when not exists (select 1 from uses where dst = t.id) and not exists (select 1 from uses where src = t.id) then 'isolated' when not exists (select 1 from uses where dst = t.id) then 'leaf' when not exists (select 1 from uses where src = t.id) then 'base' else 'intermediate' end class,
  coalesce(upstream, 0) upstream, coalesce(downstream, 0) downstream from touched t left join sizes s on s.target = t.id""")
def analysed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every touched node with its class and the sizes of its radius."""
    graph = Q._placed(spark, sf_dir)
    touched, _, found = analyses.analyse_diff(graph, P.select(spark, sf_dir, P.HUNKS), P.select(spark, sf_dir, P.CHANGED_FILES), P.select(spark, sf_dir, P.MEMBER_DIRS))
    size = lambda d: F.count_if(F.col("direction") == d).alias(d)
    sizes = found.groupBy(F.col("target").alias("id")).agg(size("upstream"), size("downstream"))
    return touched.join(classification(graph).select("id", "class"), "id").join(sizes, "id", "left").fillna(0, ["upstream", "downstream"])


@_query(Q._CRATES.replace("with nodes", "with recursive nodes") + Q._CHOSEN + """, target as (select distinct path from nodes where label = 'R2' and file is not null),
local_nodes as (select id, path from nodes where label = 'R2'), local_edges as (select src, dst from edges where label = 'R2' and relation = 'uses'),
whole_edges as (select distinct s.new_id src, d.new_id dst from edges e join nodes a on a.label = e.label and a.id = e.src join nodes b on b.label = e.label and b.id = e.dst
  join numbered s on s.path = a.path join numbered d on d.path = b.path where relation = 'uses'),
whole_nodes as (select new_id id, path from numbered)""" + Q._depth_sql_each("local") + Q._depth_sql_each("whole") + """
select l.path, l.direction, l.n n_local, w.n n_whole, w.n - l.n change from local_sizes l join whole_sizes w on w.direction = l.direction and w.path = l.path""")
def radii_in_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much further every touched node of one crate reaches in the whole workspace."""
    every = Q._labelled(spark, sf_dir)
    local = Graph(every.nodes.filter("label = 'R2'"), every.edges.filter("label = 'R2'"), "R2")
    touched = diffing.touched_nodes(local, spark.createDataFrame([("R2.rs", 3, 4)], "file string, start int, end int"))
    return measures.radius_deltas(local, workspace.unite(every).graph.stored(), touched)
