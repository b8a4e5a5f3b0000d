"""Mixing sources to target weights by hash thresholds found in nested histograms, without a sort.

Every source gets a share of the words of the mix; what a source cannot give (more than `repeat`
times its size) is shared again by weight among the rest. Inside a source, documents are taken
whole in the order of a hash: each document below the source's threshold is taken once more than
those above. The threshold comes from histograms of 12 bits of the hash: one pass sums words by
source and leading bits, the bucket where the running sum crosses the budget is the boundary, and
only the documents of that bucket are looked at again with the next 12 bits, down to single hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.llm.common import materialize, n_words

_BITS = 12
_LEVELS = 5


def _hash60(*cols: Column) -> Column:
    """60 bits of the MD5 of the values; equal on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, repeat: int = 2) -> DataFrame:
    """(source, size) rows, summed by source, to (source, source_size, target).

    Sources in order of code points, null last, weigh `weights`, repeating. Their targets sum to
    `total` times all sizes, none above `repeat` times its source's size. In closed form: sources
    ordered by cap / weight fill up first, and the first one whose cap is above its share of what
    is left sets the share of all the others.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))).cast("int") + 1)
    named = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeat)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    budget = F.sum("source_size").over(everything) * F.lit(total)
    named = named.withColumn("left_words", budget - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    named = named.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    named = named.withColumn("level", F.col("left_words") / F.col("left_weight"))
    fits = F.col("cap") / F.col("weight") >= F.col("level")
    share = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.when(share.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), share * F.col("weight")))
    return named.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, repeat: int = 2) -> DataFrame:
    """How often the mix takes each document.

    docs: doc_id, text, source (other columns are ignored). Returns doc_id, source, size (words of
    the text, 0 for null), source_size, target (of its source, double), copies (times the document
    is taken, at most `repeat`) and taken (copies * size). A source's taken words differ from its
    target by less than the words of the one document at the boundary (of all rows of that doc_id,
    if ids repeat), whichever side is nearer.

    Null source: a source of its own, last in order. Null doc_id: hashed as empty. Rows with equal
    doc_id share a hash and are taken alike. Empty texts have size 0 and take nothing. Empty input:
    empty output. Reruns agree, on any partitioning.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), _hash60(F.col("doc_id").cast("long")).alias("h"))
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    rows = materialize(rows.withColumn("key", key), "sizes")
    targets = source_targets(rows, weights=weights, total=total, repeat=repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("key", key)
    targets = materialize(targets.select("key", "source_size", "target", "whole", "rest"), "targets")

    # Each level: where the running sum over buckets crosses the rest, and what lies before it.
    edge = targets.filter("rest > 0").select("key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(_LEVELS):
        shift = _BITS * (_LEVELS - 1 - level)
        inside = rows if level == 0 else rows.join(edge.select("key", "prefix"), "key").filter(F.shiftright("h", shift + _BITS) == F.col("prefix"))
        buckets = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        buckets = buckets.join(edge, "key").withColumn("upto", F.col("before") + F.sum("words").over(running)).filter("upto > rest")
        first = buckets.groupBy("key").agg(F.min(F.struct("bucket", "upto", "words")).alias("b"), F.any_value("rest").alias("rest"))
        edge = materialize(first.select("key", "rest", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.words")).alias("before"), F.col("b.upto").alias("upto")), "edge")
    nearer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("before"))
    limits = targets.join(edge.select("key", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("limit")), "key", "left")
    out = rows.join(limits, "key")
    # No crossing: the rest takes every document (rest equals the size) or nothing (rest is 0).
    more = F.when(F.col("limit").isNotNull(), F.col("h") < F.col("limit")).otherwise(F.col("rest") > 0)
    copies = F.col("whole") + more.cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
