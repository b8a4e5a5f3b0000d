"""Quality rules: base statistics, and a hashed n-gram likelihood ratio against trusted text.

Words and word pairs are hashed to a fixed number of buckets. Two multinomials over the buckets
are estimated, one from all documents and one from trusted ones; the score of a document is the
sum of the log-likelihood ratios of its n-grams, divided by their number. Every document is
scored, and one threshold, found on the scores of labelled documents, decides.

DataFrame functions only: the words of a text are one array, and hashing, sums and the search for
repeated windows are array functions over it, so no text leaves its row but for the counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import WORD, held, materialize

_SYMBOLS = "[#*$%&|<>]"
_BUCKETS = 1 << 14
_PSEUDO = 0.5
_BINS = 2000
_GOOD = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(_BUCKETS)).cast("int")


def _hashed(words: Column) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    later = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(F.transform(words, lambda w: _bucket(w)), F.transform(later, lambda w, i: _bucket(F.get(words, i), w)))


def _window_order(words: Column, n: Column) -> tuple[Column, Callable[[Column, Column], Column], Callable[[Column], Column]]:
    """The 3-word windows in order of their hashes, a test for equal windows, and their positions.

    Window hashes carry their position in their low bits; sorted, equal windows are neighbours,
    and neighbours with equal high bits are compared word by word.
    """
    bits = F.ceil(F.log2(n.cast("double") + 2)).cast("int")
    start = F.sequence(F.lit(0), n.cast("int") - 3)
    packed = F.transform(start, lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits) + i)
    ordered = F.sort_array(packed)
    place = lambda v: F.pmod(v, F.call_function("shiftleft", F.lit(1).cast("long"), bits)).cast("int")

    def same(a: Column, b: Column) -> Column:
        i, j = place(a), place(b)
        whole = (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))
        return F.coalesce((F.call_function("shiftright", a, bits) == F.call_function("shiftright", b, bits)) & whole, F.lit(False))

    return ordered, same, place


def text_statistics(docs: DataFrame, *extra: Column) -> DataFrame:
    """docs: doc_id, text. One row each: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    word_chars: code points in words; n_dup_lines: lines with a word that equal an earlier line;
    n_repeat_words: words in 3-word windows found twice or more, the first included. Null text: 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = held(docs.select("doc_id", text.alias("text")), "words", _words(text))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    ordered, same, place = _window_order(F.col("words"), F.col("n_words"))
    rows = held(rows, "ordered", F.when(F.col("n_words") > 3, ordered))
    o = F.col("ordered")
    twice = F.filter(o, lambda v, i: same(v, F.get(o, i + 1)) | same(v, F.get(o, i - 1)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda v: F.array(place(v), place(v) + 1, place(v) + 2))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    return rows.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(o.isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        *extra,
    )


def fit_ratios(docs: DataFrame, labels: DataFrame, *, trusted_rows: int = 20_000) -> np.ndarray:
    """Log-likelihood ratio of each bucket, trusted over raw.

    The raw counts cover all documents. Trusted are documents with quality 1; of more than
    `trusted_rows`, those with the smallest hashes of doc_id are used.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows).withColumn("trusted", F.lit(1))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(good), "doc_id", "left")
    marked = held(marked.select("trusted", "text"), "words", _words(F.coalesce("text", F.lit(""))))
    grams = marked.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(_hashed(F.col("words"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("good")).collect()  # at most _BUCKETS rows
    raw, target = np.full(_BUCKETS, _PSEUDO), np.full(_BUCKETS, _PSEUDO)
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["good"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score(ratios: np.ndarray, words: Column) -> Column:
    table = F.lit(np.asarray(ratios, dtype=np.float64))
    ratio = F.transform(words, lambda w, i: F.get(table, _bucket(w)) + F.when(i > 0, F.get(table, _bucket(F.get(words, i - 1), w))).otherwise(0.0))
    total = F.aggregate(ratio, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1)).otherwise(F.lit(float("-inf")))


def fit_threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The score that best parts quality 1 from 0, from a histogram of labelled rows.

    A share of good documents lost weighs _GOOD times as much as the same share of bad ones kept.
    With no rows of either label, nothing is rejected.
    """
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = scored.filter("score > double('-Infinity')").select("doc_id", "score").join(known, "doc_id")
    low, high = known.agg(F.min("score"), F.max("score")).first()
    if low is None or not math.isfinite(high - low) or high == low:
        return -math.inf
    bin_of = F.least(F.floor((F.col("score") - low) / (high - low) * _BINS), F.lit(_BINS - 1)).cast("int")
    good, bad = np.zeros(_BINS), np.zeros(_BINS)
    for r in known.groupBy(bin_of.alias("bin"), "quality").count().collect():  # at most 2 * _BINS rows
        (good if r["quality"] == 1 else bad)[r["bin"]] += r["count"]
    if not good.sum() or not bad.sum():
        return -math.inf
    gain = np.concatenate(([0.0], np.cumsum(bad / bad.sum() - _GOOD * good / good.sum())))
    return low + (high - low) * int(gain.argmax()) / _BINS


def quality_rules(docs: DataFrame, labels: DataFrame, *, min_words: int = 50, repeat_percent: int = 50, trusted_rows: int = 20_000) -> DataFrame:
    """Judge every document.

    docs: doc_id long, text string; labels: doc_id long, quality int (other columns are ignored).
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer
    words than min_words, or more than repeat_percent of them repeated), score and kept (neither
    base_failed nor a score below the threshold). Null text counts as empty and fails; null doc_id
    is kept as null; repeated rows come back each. Empty labels: only the base rules decide.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratios = fit_ratios(docs, labels, trusted_rows=trusted_rows)
    scored = materialize(text_statistics(docs, score(ratios, F.col("words")).alias("score")), "quality")
    threshold = fit_threshold(scored, labels)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
