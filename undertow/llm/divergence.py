"""How far the sources of a language are from each other in their terms, by an inverted index of corrections.

A pair of sources sums one number f over all V kept terms of their language, most of which neither
of them uses. So each pair starts from a *baseline*, V times f of two zero counts, and only the
postings of the index correct it:

*   a term that a source uses changes f against every other source in the same way as long as the
    other one does not use it; what it adds depends on the count alone, so the terms of a source are
    first counted by their count, and this histogram meets the other sources;
*   a term that both use (two postings of one list) adds what is still missing.

Corrections of zero are not emitted. Everything is integer arithmetic in decimals of 38 digits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.llm.common import materialize

#: Letters A-Z and everything beyond ASCII make up a term; in UTF-8, these are single bytes or runs of high ones.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Counted terms that a task holds before it hands them on.
_HELD = 200_000
_COUNTS = "lang string, source string, term string, n long, docs long"
_SCALE = 1_000_000_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to counts of terms, added up within the task as far as memory allows."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            same = lambda x: pa.array([x] * len(terms), pa.string())
            columns = [same(lang), same(source), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            terms = _TERM.findall(text.encode().translate(_LOWER))
            n.update(terms)
            docs.update(set(terms))
            held += len(n) - before
            if held > _HELD:
                yield from rows()
                found, held = {}, 0
    yield from rows()


def _big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def share(n: str | Column, total: str | Column) -> Column:
    """p of a count: 1 + floor(10^9 * (count + 1) / (N + V)); total is N + V, and above 0."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(_SCALE).cast("decimal(10,0)") * _big(_big(n) + F.lit(1)), _big(total))


def distance(p: str | Column, q: str | Column) -> Column:
    """f of two shares: floor((p - q)^2 / q). Shares are 1 to 10^9 + 1, so the square fits 64 bits."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _total(value: str | Column, name: str) -> list[Column]:
    """An exact sum that no number of rows overflows: of the upper and the lower 32 bits apart."""
    value = F.col(value) if isinstance(value, str) else value
    return [F.sum(F.shiftright(value, 32)).alias(f"{name}_high"), F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_low")]


def _joined(name: str) -> Column:
    return (F.col(f"{name}_high").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(f"{name}_low").cast("decimal(20,0)")).cast("decimal(38,0)")


def _index(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n): the postings of kept terms. The window is over the sources of one term."""
    counts = docs.select("lang", "source", "text").mapInArrow(_count, _COUNTS)
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    whole = counts.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term)})
    return whole.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n")


def source_divergence(docs: DataFrame, *, least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """Each source of a language against the others, and the terms in which it stands out.

    docs: lang, source, text (other columns are ignored; null counts as '' in all three). Terms are
    runs of letters A-Z and of characters beyond ASCII, with A-Z lower-cased. A language keeps the
    terms that at least `least_docs` of its rows hold. Every (lang, source) that occurs is a group,
    even without any term. Returns (lang, source, part, item, value, rank):

    part "pair": item is each other source of the language, value the sum of distance() over all
    kept terms (0 if there are none). part "term": item is a kept term that the group uses more than
    the language does, value its distance from it; the first `top_terms` only. rank counts from 1 in
    each group and part, by falling value, ties by the UTF-8 bytes of item.

    Repeated rows are documents of their own. Empty texts make a group without terms. Long texts are
    counted whole. An empty table gives no rows; so does, for "pair", a language with one source.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    index = materialize(_index(docs, least_docs), "postings")
    sizes = index.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    # Once for each kept term of a language: its first posting stands for it.
    kept = index.groupBy("lang", "term").agg(F.any_value("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_size"))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("rows")).select("lang", "source")
    groups = groups.join(sizes, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["size", "v", "lang_size"])
    groups = groups.withColumns({"total": F.col("size") + F.col("v"), "lang_total": F.col("lang_size") + F.col("v")})
    groups = materialize(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), "total"))), "groups")
    shares = index.join(groups.select("lang", "source", "total", "lang_total", "p0"), ["lang", "source"])
    shares = materialize(shares.select("lang", "source", "term", "n", share("n", "total").alias("p"), "p0", share("lang_n", "lang_total").alias("q")), "shares")

    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    pairs = _pair_sums(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top_terms))


def _pair_sums(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each source against each other one: the baseline and its corrections."""
    me = groups.select("lang", "source", "p0", "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = me.join(other, "lang").filter("source != item")  # as many rows as the result has
    zero = distance("p0", "q0")
    pairs = base.select("lang", "source", "item", F.coalesce(_big("v") * _big(zero), F.lit(0)).cast("decimal(38,0)").alias("value"))

    # One side uses the term: the same for all terms of one count.
    counted = materialize(shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k")), "counts")
    times = lambda d: F.sum((_big("k") * _big(d)).cast("decimal(38,0)")).cast("decimal(38,0)").alias("value")
    key = ["lang", "source", "item"]
    mine = counted.join(other, "lang").filter("source != item").groupBy(*key).agg(times(distance("p", "q0") - zero))
    theirs = counted.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"), "k").join(me.select("lang", "source", "p0"), "lang").filter("source != item")
    theirs = theirs.groupBy(*key).agg(times(distance("p0", "q") - zero))

    # Both use it: what the two corrections above got wrong, in both directions at once.
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    change = lambda p, p0, q, q0: distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)
    met = left.join(right, ["lang", "term"]).filter("a < b")
    met = met.select("lang", "a", "b", change("pa", "a0", "pb", "b0").alias("there"), change("pb", "b0", "pa", "a0").alias("back")).filter("there != 0 or back != 0")
    met = met.groupBy("lang", "a", "b").agg(*_total("there", "there"), *_total("back", "back"))
    both = [met.select("lang", F.col(x).alias("source"), F.col(y).alias("item"), _joined(way).alias("value")) for x, y, way in (("a", "b", "there"), ("b", "a", "back"))]
    every = reduce(DataFrame.unionByName, [pairs, mine, theirs, *both])
    return every.groupBy(*key).agg(F.sum("value").cast("long").alias("value"))
