"""Schemas, closed values and errors of the graph model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Closed values of the model (fixed values).
KINDS = ("crate", "mod", "fn", "struct", "union", "enum", "variant", "const", "static", "trait", "type", "builtin", "macro")
RELATIONS = ("owns", "uses")
USES_KINDS = ("reference", "import")
VISIBILITIES = ("pub", "pub(crate)", "pub(super)", "priv")
SYSROOT = ("std", "core", "alloc", "proc_macro", "test")
MODULE_KINDS = ("crate", "mod")
TYPE_KINDS = ("struct", "enum", "union", "trait")

POSITION = T.StructType([T.StructField("file", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])

NODE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("is_const", T.BooleanType()),
        T.StructField("is_async", T.BooleanType()),
        T.StructField("is_unsafe", T.BooleanType()),
        T.StructField("is_non_exhaustive", T.BooleanType()),
        T.StructField("trait", T.StringType()),
        T.StructField("trait_ref", T.StringType()),
        T.StructField("macro_kind", T.StringType()),
        T.StructField("cfg", T.StringType()),
        T.StructField("position", POSITION),
    ]
)

EDGE_SCHEMA = T.StructType(
    [
        T.StructField("edge_seq", T.LongType()),
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("relation", T.StringType()),
        T.StructField("uses_kind", T.StringType()),
    ]
)

#: One JSON document for each graph.
DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("crate", T.StringType()),
        T.StructField("nodes", T.ArrayType(T.StructType([*(f for f in NODE_SCHEMA.fields if f.name != "cfg"), T.StructField("cfg", T.VariantType())]))),
        T.StructField(
            "edges",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("from", T.StringType()),
                        T.StructField("id_from", T.LongType()),
                        T.StructField("to", T.StringType()),
                        T.StructField("id_to", T.LongType()),
                        T.StructField("relation", T.StringType()),
                        T.StructField("uses_kind", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


class GraphError(ValueError):
    """A graph or a request breaks a rule of the model."""


class InvalidGraph(GraphError):
    """Duplicate ids, dangling edges or values outside the closed sets."""


class TargetNotFound(GraphError):
    """No node has the requested path or id."""


class UntypedUses(GraphError):
    """Reference-only uses were asked of a graph whose uses edges carry no kind."""


class Undecided(GraphError):
    """A path collision could neither be told apart nor merged."""
