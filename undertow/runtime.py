"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. One machine may go without: a temporary one is set; a cluster may not."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="undertow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._undertow_path = path
    return stored


def stored_once(df: DataFrame, name: str) -> DataFrame:
    """df as a stored table: itself if it is one, for tables that a plan reads more than once."""
    return df if hasattr(df, "_undertow_path") else materialize(df, name)


def stored_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """The distinct rows of df, dealt by a column and stored in as many buckets as shuffles have parts: a join on the column reads it without a shuffle.

    For tables that many joins read. Buckets need a table; its name leaves the catalogue at once, its files stay in the shared folder.
    """
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).distinct().write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}")
    writer.bucketBy(n, key).saveAsTable(table)
    stored = spark.table(table)
    stored.schema  # resolved before the name goes
    spark.sql(f"drop table {table}")
    return stored


def materialize_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """materialize, and aggregates over its rows that the writing job finds on its way; null for none is 0."""
    seen = Observation()
    stored = materialize(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    return stored, {k: v or 0 for k, v in seen.get.items()}


def shuffled(df: DataFrame) -> DataFrame:
    """df as one side of a join for which both sides are shuffled, however small it looks.

    Spark takes the size of a stored table from its compressed files, and that of some of its columns from
    their share of the widths of all, null ones included. By that, millions of ids look like a few
    MB, and would pass through the driver to be broadcast. For tables with a row for a node, an edge or a pair.
    """
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize that nothing will read again."""
    for df in tables:
        discard_folder(df.sparkSession, df._undertow_path)


def discard_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of our own below the shared one that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
