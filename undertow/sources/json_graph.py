"""Graph documents in JSON, checked at the boundary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.functions import base_kind
from undertow.graph import Graph
from undertow.schema import DOCUMENT_SCHEMA, KINDS, RELATIONS, VISIBILITIES, InvalidGraph

#: Edges at one missing id are listed so many at a time.
_AT_ONCE = 10_000
_FLAGS = ("is_const", "is_async", "is_unsafe", "is_non_exhaustive")


def parse_uses_kind(relation: Column, kind: Column) -> Column:
    """reference or import; other texts count as import; owns edges have none."""
    return F.when((relation == "uses") & kind.isNotNull(), F.when(kind == "reference", kind).otherwise(F.lit("import")))


def visibility_is_valid(text: Column) -> Column:
    return text.isin(*VISIBILITIES) | (F.trim(F.regexp_extract(text, r"^pub\(in (.+)\)$", 1)) != "")


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes of documents as columns of the model."""
    nodes = nodes.withColumn("cfg", F.to_json("cfg")).withColumns({c: F.coalesce(c, F.lit(False)) for c in _FLAGS})
    return nodes.withColumn("kind", base_kind(F.col("kind")))


def graph_edges(edges: DataFrame) -> DataFrame:
    """The edges `e` of documents, with their place edge_seq, as columns of the model."""
    label = ["label"] if "label" in edges.columns else []
    return edges.select(F.col("edge_seq").cast("long").alias("edge_seq"), F.col("e.id_from").alias("src"), F.col("e.id_to").alias("dst"), F.col("e.relation").alias("relation"), parse_uses_kind(F.col("e.relation"), F.col("e.uses_kind")).alias("uses_kind"), *label)


def documents_to_graph(documents: DataFrame, name: str = "") -> Graph:
    """Rows of DOCUMENT_SCHEMA, optionally with a label, to one graph; edge_seq is the place in the document."""
    label = ["label"] if "label" in documents.columns else []
    nodes = documents.select(*label, F.explode("nodes").alias("n")).select(*label, "n.*")
    return Graph.of(graph_nodes(nodes), graph_edges(documents.select(*label, F.posexplode("edges").alias("edge_seq", "e"))), name)


def violations(graph: Graph) -> DataFrame:
    """(rule, value) of whatever breaks the model: closed values, duplicate ids, dangling edges."""
    label = ["label"] if "label" in graph.nodes.columns else []
    row = lambda rule, value: F.struct(F.lit(rule).alias("rule"), value.cast("string").alias("value"))
    unknown = lambda c, bad: F.when(F.coalesce(bad, F.lit(True)), row(f"unknown {c}", F.col(c)))
    # One pass over the nodes and one over the edges, however many rules there are.
    of_rows = lambda df, *rules: df.select(F.explode(F.array_compact(F.array(*rules))).alias("v")).select("v.*")
    missing = [F.when(F.col(c).isNull(), row(f"missing {c}", F.lit(""))) for c in ("id", "path", "name")]
    found = of_rows(graph.nodes, unknown("kind", ~F.col("kind").isin(*KINDS)), unknown("visibility", ~visibility_is_valid(F.col("visibility"))), *missing)
    found = found.union(of_rows(graph.edges, unknown("relation", ~F.col("relation").isin(*RELATIONS))))
    # Ids of nodes and ends of edges meet by one shuffle, as counts for each id: no edge is joined or sorted.
    count = lambda n, src, dst: [F.lit(k).cast("long").alias(c) for c, k in (("n", n), ("src", src), ("dst", dst))]
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), *count(0, 1, 0)), F.struct(F.col("dst").alias("id"), *count(0, 0, 1))))
    ids = graph.nodes.select(*label, "id", *count(1, 0, 0)).unionByName(graph.edges.select(*label, ends.alias("e")).select(*label, "e.*"))
    ids = ids.groupBy(*label, "id").agg(*[F.sum(c).alias(c) for c in ("n", "src", "dst")])
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*label, "id")], F.col("n") > 0)
    fault = lambda rule, when, n: F.when(when, F.struct(F.lit(rule).alias("rule"), n.alias("left")))
    faults = [fault("duplicate id", F.col("n") > 1, F.lit(1).cast("long")), *[fault(f"dangling {end}", ~known & (F.col(end) > 0), F.col(end)) for end in ("src", "dst")]]
    faults = ids.select(F.col("id").cast("string").alias("value"), F.explode(F.array_compact(F.array(*faults))).alias("f")).select("value", "f.*")
    # A row for each edge, by two lists of bounded length.
    some = faults.select("value", "rule", "left", F.explode(F.sequence(F.lit(0), F.col("left") - 1, F.lit(_AT_ONCE))).alias("first"))
    each = some.select("value", F.explode(F.array_repeat("rule", F.least(F.col("left") - F.col("first"), F.lit(_AT_ONCE)).cast("int"))).alias("rule"))
    found = found.union(each.select("rule", "value"))
    return found


def checked(graph: Graph) -> Graph:
    """The graph itself, or InvalidGraph with the first violations."""
    first = violations(graph).limit(5).collect()
    if first:
        raise InvalidGraph("; ".join(f"{r['rule']}: {r['value']}" for r in first))
    return graph


def read_graph(spark: SparkSession, path: str, *, label: str | None = None, lines: bool = False) -> Graph:
    """One JSON document (or several: one for each file, or with `lines` one on each line) as a checked graph.

    The result is stored, so that documents are parsed twice, once for nodes and once for edges, whatever is checked.
    """
    documents = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    name = documents.select("crate").first()
    if label is not None:
        documents = documents.withColumn("label", F.lit(label))
    return checked(documents_to_graph(documents, name["crate"] if name and name["crate"] else "").stored())
