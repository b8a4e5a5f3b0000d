"""Numbers in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.runtime import materialize


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the place of each row in the order of some columns, from 0.

    Rows are dealt by ranges of the columns and counted in their partition; partitions add the sizes
    of those before them. Rows that are equal in all of `order` get places in no certain order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("part__", F.spark_partition_id()).withColumn("within__", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = placed.groupBy("part__").agg(F.count("*").alias("n__"))
    # One row for each partition, however many rows there are.
    before = F.coalesce(F.sum("n__").over(W.orderBy("part__").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part__", before.alias("start__"))
    return placed.join(starts, "part__").withColumn(name, F.col("start__") + F.col("within__")).drop("part__", "within__", "start__")
