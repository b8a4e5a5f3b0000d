"""Captured output of `git diff --unified=0` as changed line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.functions import line_count
from undertow.runtime import materialize

_NOWHERE = "/dev/null"
_HUNK = r"^@@[^+]*\+([0-9]+)(?:,([0-9]+))?(?: |$)"


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """(diff_id, block, at, line) of text files, one diff in each; a large file is read by many tasks.

    diff_id is the file. Lines of a file stand by the offset of their block, then by their place in it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("diff_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return lines


def parse_diff(diffs: DataFrame) -> DataFrame:
    """(diff_id, text) rows to (diff_id, file, start, end): the ranges on the new side, from 1, inclusive.

    A file line holds for the hunks below it, until the next; "/dev/null" ends it. Hunks that add
    no line give no range.
    """
    return parse_diff_lines(diffs.select("diff_id", F.posexplode(F.split("text", "\r?\n")).alias("at", "line")), ["at"])


def parse_diff_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """The same of single lines (diff_id, line), which stand by the columns `order`; a long diff takes many tasks.

    Only file lines and hunks are kept, and dealt by ranges of (diff_id, order). Within a range,
    each hunk takes the last file line before it. Hunks without one take the last file line of the
    ranges before, of which there is one row for each range.
    """
    header = F.trim(F.when(F.startswith("line", F.lit("+++ ")), F.substr(F.col("line"), F.lit(5))))
    lines = lines.select("diff_id", *order, "line", F.regexp_replace(header, "^b/", "").alias("file"))
    lines = lines.filter(F.col("file").isNotNull() | F.col("line").rlike(_HUNK))
    dealt = lines.repartitionByRange("diff_id", *order).sortWithinPartitions("diff_id", *order)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "diff-lines")
    above = W.partitionBy("part", "diff_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    lines = dealt.withColumn("file", F.last("file", ignorenulls=True).over(above))

    # Only the last diff of a range can go on in the next ones.
    ends = dealt.groupBy("part").agg(F.max("diff_id").alias("diff_id"))
    last = F.max_by("file", F.struct(*order)).alias("carried")
    tails = dealt.filter("file is not null").join(ends, ["part", "diff_id"]).groupBy("part", "diff_id").agg(last)
    starts = dealt.groupBy("part").agg(F.min("diff_id").alias("diff_id")).select(F.col("part").alias("into"), "diff_id")
    carried = starts.join(tails, "diff_id").filter("part < into").groupBy(F.col("into").alias("part"), "diff_id").agg(F.max_by("carried", "part").alias("carried"))
    lines = lines.join(carried, ["part", "diff_id"], "left").withColumn("file", F.coalesce("file", "carried"))

    number = lambda k: F.regexp_extract("line", _HUNK, k)
    hunks = lines.filter(F.col("line").rlike(_HUNK) & F.col("file").isNotNull() & (F.col("file") != _NOWHERE))
    hunks = hunks.select("diff_id", "file", number(1).try_cast("int").alias("start"), F.when(number(2) == "", 1).otherwise(number(2).try_cast("int")).alias("n"))
    return hunks.filter("start > 0 and n > 0").select("diff_id", "file", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def untracked_ranges(files: DataFrame) -> DataFrame:
    """(file, text) of untracked files to (file, start, end): all their lines."""
    return files.select("file", F.lit(1).alias("start"), line_count(F.col("text")).cast("int").alias("end")).filter("end > 0")
