"""A dependency graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.runtime import materialize
from undertow.schema import EDGE_SCHEMA, NODE_SCHEMA


def _fitted(df: DataFrame, schema, defaults: dict[str, Column]) -> DataFrame:
    """The schema's columns in order; those that are missing get their default or null. Others stay behind them."""
    known = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*known, *[c for c in df.columns if c not in schema.names])


@dataclass(frozen=True)
class Graph:
    """nodes: NODE_SCHEMA; edges: EDGE_SCHEMA. Both may carry more columns, such as label."""

    nodes: DataFrame
    edges: DataFrame
    name: str = ""

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, name: str = "") -> Graph:
        """A graph of frames that may lack optional columns."""
        false = F.lit(False)
        flags = {c: false for c in ("is_const", "is_async", "is_unsafe", "is_non_exhaustive")}
        last = F.substring_index(F.col("path"), "::", -1) if "path" in nodes.columns else F.lit(None)
        nodes = _fitted(nodes, NODE_SCHEMA, flags | {"visibility": F.lit("pub"), "name": last})
        edges = _fitted(edges, EDGE_SCHEMA, {"edge_seq": F.lit(0)})
        return Graph(nodes, edges, name)

    def uses(self) -> DataFrame:
        return self.edges.filter("relation = 'uses'")

    def owns(self) -> DataFrame:
        return self.edges.filter("relation = 'owns'")

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def stored(self) -> Graph:
        """The same graph, written once to the shared folder."""
        return replace(self, nodes=materialize(self.nodes, "nodes"), edges=materialize(self.edges, "edges"))

    def with_paths(self) -> DataFrame:
        """Edges with src_path and dst_path."""
        n = self.nodes.select("id", "path")
        src = n.select(F.col("id").alias("src"), F.col("path").alias("src_path"))
        dst = n.select(F.col("id").alias("dst"), F.col("path").alias("dst_path"))
        return self.edges.join(src, "src").join(dst, "dst")
