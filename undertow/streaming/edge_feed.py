"""An extension beyond batch analyses: degrees kept up to date from a stream of edge changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

CHANGE_SCHEMA = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("delta", T.IntegerType())])


@dataclass(frozen=True)
class EdgeFeed:
    """Signed uses edges (delta 1 or -1) in a folder become signed degrees, one batch at a time.

    Each micro-batch replaces the file set of its own number, so a batch that runs again after a
    failure counts once.
    """

    spark: SparkSession
    store: str

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        def fold(batch: DataFrame, number: int) -> None:
            ends = batch.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.col("delta").alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.col("delta").alias("o")))).alias("e"))
            sums = ends.groupBy("e.id").agg(F.sum("e.i").alias("uses_in"), F.sum("e.o").alias("uses_out"))
            sums.write.mode("overwrite").parquet(f"{self.store}/batch={number}")

        return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def degrees(self) -> DataFrame:
        stored = self.spark.read.schema("id long, uses_in long, uses_out long").option("basePath", self.store).parquet(f"{self.store}/batch=*")
        return stored.groupBy("id").agg(F.sum("uses_in").alias("uses_in"), F.sum("uses_out").alias("uses_out"))
