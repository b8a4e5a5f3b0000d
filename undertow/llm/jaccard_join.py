"""Exact Jaccard self-join of documents on word n-grams, by rare-first prefixes.

Every document becomes the set of its n-grams, hashed to 64 bits. Documents with equal sets form a
class, for which one of them stands. Which classes can be similar is settled by filters that lose
nothing:

1.  *Prefixes.* Of a set of n, the e smallest hashes are drawn, so many that two similar sets must
    share at least l of those (l grows with the set, see Sizes). Counted over all documents, the
    drawn n-grams are put in order, the rarest first; the last l - 1 of them can be left out, as
    similar sets still share one of the others. These form the prefix, and n-grams that nobody shares need no list.
2.  *Length and position.* Two classes of a list are a candidate if their sizes are similar enough, and if
    behind the places of the n-gram there are enough n-grams left to share.
3.  *Suffixes.* The hashes of a set are counted in `_BINS` ranges. Counts that differ show how many
    n-grams the two sets don't share, at least; too many, and the pair goes.
4.  *Verification.* The whole sets of what is left are intersected, once for each pair.

Lists of up to `_SHORT` classes give pairs. The classes of longer lists, connected by those, form a
*family*, whose pairs are never listed: it is cut into bands of similar size and blocks of bounded
memory, and two blocks at a time meet in one task, whose result has one row for each class: the
number of its links, and a class that it is connected with. A pair within a family is compared there and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undertow.llm.common import discard, materialize
from undertow.llm.components import components

_BINS = 32
#: Classes of a list that are paired directly.
_SHORT = 16
#: N-grams, and classes, of a block.
_BLOCK_GRAMS, _BLOCK_CLASSES = 1 << 20, 1024
#: Columns of a block that are multiplied at once.
_WIDE = 4096
#: Keys of texts that are sent to every task; more are joined by a shuffle.
_BROADCAST_KEYS = 200_000
#: Bytes of text after which a task hands on what it has.
_SLICE = 1 << 22
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Sizes:
    """Numbers that the filters need, of a set of n (a number or a column of longs), for a similarity of percent / 100."""

    percent: int

    def partner(self, n):
        """The least size of a similar set, which is also the least number of n-grams shared with one."""
        return self._div(n * self.percent + 99, 100)

    def shared(self, n):
        """l: the least number of drawn n-grams that a pair shares whose smaller l this is."""
        return self._div(n * 3, 100) + 1

    def drawn(self, n):
        """e: of the rest behind the e smallest hashes, a similar set shares partner(n) - l at most."""
        return n - self.partner(n) + self.shared(n)

    def prefix(self, n):
        """Drawn n-grams without the last l - 1, l being that of the smallest similar set."""
        return self.drawn(n) - self.shared(self.partner(n)) + 1

    def overlap(self, a, b):
        """The least number of n-grams that similar sets of a and b share."""
        return self._div((a + b) * self.percent + 99 + self.percent, 100 + self.percent)

    @staticmethod
    def _div(a, b):
        return F.call_function("div", a, F.lit(b)) if isinstance(a, Column) else a // b


def ngram_set(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-grams; of all its words together, if those are fewer."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in spans), np.uint64, len(words) - size + 1))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes]]:
    for k, text in enumerate(batch.column(column)):
        yield k, (text.as_py() or "").encode()


_ROWS = "doc_id long, tid binary, n_shingles long, cls binary, drawn array<long>, bins array<int>"


def _rows(size: int, percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent)
        for batch in batches:
            first, seen, out = 0, 0, []
            for k, text in _texts(batch, 2):
                grams = ngram_set(text, size)
                n = len(grams)
                bins = np.bincount((grams >> np.uint64(59)).astype(np.int64), minlength=_BINS).astype(np.int32)
                cls = xxhash.xxh3_128_digest(grams.tobytes()) if n else None
                out.append((n, cls, grams[: sizes.drawn(n)].view(np.int64) if n else grams.view(np.int64), bins))
                seen += len(text)
                if seen > _SLICE or k == batch.num_rows - 1:
                    columns = [batch.column(c).slice(first, len(out)) for c in (0, 1)]
                    columns += [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())]
                    for at in (2, 3):
                        bounds = np.concatenate(([0], np.cumsum([len(x[at]) for x in out]))).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([x[at] for x in out]))))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tid", "n_shingles", "cls", "drawn", "bins"])
                    first, seen, out = k + 1, 0, []

    return task


def _sets(size: int):
    """(cid, text) to (cid, grams)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, seen, out = 0, 0, []
            for k, text in _texts(batch, 1):
                out.append(ngram_set(text, size).tobytes())
                seen += len(text)
                if seen > _SLICE or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), pa.array(out, pa.binary())], names=["cid", "grams"])
                    first, seen, out = k + 1, 0, []

    return task


_CELL = ["family", "left_band", "left", "right_band", "right"]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list, list]]:
    """Rows (cell, side, cid, numbers) sorted by cell, side and cid, as (cell, left, right) of distinct (cid, array)."""
    cell, sides = None, ([], [])
    for batch in batches:
        values = batch.column(7)
        packed = pa.types.is_binary(values.type)
        for k, (*key, side, cid) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7)))):
            if key != cell:
                if cell is not None:
                    yield tuple(cell), *sides
                cell, sides = key, ([], [])
            if not sides[side] or sides[side][-1][0] != cid:
                numbers = np.frombuffer(values[k].as_buffer(), np.uint64) if packed else values[k].values.to_numpy()
                sides[side].append((cid, numbers.copy()))
    if cell is not None:
        yield tuple(cell), *sides


def _screen(percent: int):
    """Of each cell, the classes that some other class of the other side may be similar to, as far as their bins say."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent)
        for cell, left, right in _cells(batches):
            same = cell[1:3] == cell[3:5]
            a = np.array([x[1] for x in left], np.int32).reshape(-1, _BINS)
            b = a if same else np.array([x[1] for x in right], np.int32).reshape(-1, _BINS)
            na, nb = a.sum(axis=1, dtype=np.int64), b.sum(axis=1, dtype=np.int64)
            hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
            for at in range(0, len(a), 64):
                apart = np.abs(a[at : at + 64, None, :] - b[None, :, :]).sum(axis=2)
                both = na[at : at + 64, None] + nb[None, :]
                near = apart <= both - 2 * sizes.overlap(na[at : at + 64, None], nb[None, :])
                if same:
                    near[np.arange(len(near)), at + np.arange(len(near))] = False
                hit_a[at : at + 64] = near.any(axis=1)
                hit_b |= near.any(axis=0)
            kept = [(0, left[k][0]) for k in np.flatnonzero(hit_a | hit_b if same else hit_a)]
            if not same:
                kept += [(1, right[k][0]) for k in np.flatnonzero(hit_b)]
            if kept:
                columns = [pa.array([c] * len(kept), pa.int64()) for c in cell]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in kept], pa.int32()), pa.array([x[1] for x in kept], pa.int64())], names=[*_CELL, "side", "cid"])

    return task


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each one of b: products of 0/1 matrices, some columns at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    if not a or not b:
        return out
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    if not len(both):
        return out

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        column = np.minimum(np.searchsorted(both, values), len(both) - 1)
        known = both[column] == values
        by = np.argsort(column[known], kind="stable")
        return column[known][by], owner[known][by]

    (ca, oa), (cb, ob) = placed(a), placed(b)
    for at in range(0, len(both), _WIDE):
        parts = []
        for column, owner, n in ((ca, oa, len(a)), (cb, ob, len(b))):
            low, high = np.searchsorted(column, (at, at + _WIDE))
            ones = np.zeros((n, min(_WIDE, len(both) - at)), np.float32)
            ones[owner[low:high], column[low:high] - at] = 1
            parts.append(ones)
        out += parts[0] @ parts[1].T
    return out


def _connected(near: np.ndarray, same: bool) -> np.ndarray:
    """For each class of a cell (the left ones, then the right ones), the place of one that stands for all connected with it."""
    n, m = near.shape
    root = np.full(n if same else n + m, -1)
    for k in np.flatnonzero(near.any(axis=1)):
        if root[k] >= 0:
            continue
        left, right = np.zeros(n, bool), np.zeros(m, bool)
        left[k] = True
        before = 0
        while (now := int(left.sum() + right.sum())) != before:
            before = now
            right |= near[left].any(axis=0)
            left |= near[:, right].any(axis=1)
            if same:
                left = right = left | right
        root[np.flatnonzero(left)] = k
        if not same:
            root[n + np.flatnonzero(right)] = k
    return root


def _verify(percent: int):
    """Of each cell, (a, b, n): the number of links of each class that has some, and a class connected with it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, left, right in _cells(batches):
            same = cell[1:3] == cell[3:5]
            right = left if same else right
            sets = [x[1] for x in left], [x[1] for x in right]
            shared = _overlaps(*sets).astype(np.int64)
            sizes = [np.array([len(x) for x in s], np.int64) for s in sets]
            near = (shared > 0) & (100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared))
            if same:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            root, members = _connected(near, same), left if same else left + right
            links = near.sum(axis=1) if same else np.concatenate((near.sum(axis=1), near.sum(axis=0)))
            at = np.flatnonzero(links)
            ids = np.array([x[0] for x in members], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]]), pa.array(links[at].astype(np.int64))], names=["a", "b", "n"])

    return task


def jaccard_join(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose sets of `size`-word n-grams have a Jaccard similarity of percent / 100 or more.

    docs: doc_id long, text string (other columns are ignored). Words are runs of anything but space
    and \\t to \\r, with A-Z lower-cased. Fewer words than `size` are one n-gram together. Returns one
    row for each input row: doc_id, n_shingles (size of the set), class_id (the smallest doc_id with
    an equal set), n_links (other classes that its class is linked with, all of them) and component_id
    (the smallest doc_id reachable over links, itself included).

    Null or empty text, or one without words: an empty set, linked with nothing, in a class and a
    component of its own. Null doc_id: the row takes class and component of the others with its set,
    null if none has an id. Repeated rows: each comes back. Long texts count whole, in memory as long as their own task holds
    them. No loss: filters drop only what cannot be similar. Empty input: empty output.
    """
    if not 1 <= percent <= 100 or size < 1:
        raise ValueError("percent is 1 to 100 and size at least 1")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    # The number of a row has to stay what it is, so it is given as the rows are written.
    rows = materialize(docs.mapInArrow(_rows(size, percent), _ROWS).withColumn("rid", F.monotonically_increasing_id()), "sets")
    first = F.min(F.struct("rid", "doc_id", "tid")).alias("first")
    classes = rows.filter("cls is not null").groupBy("cls").agg(first, F.any_value("n_shingles").alias("n"), F.min("doc_id").alias("class_id"))
    classes = materialize(classes.select("cls", F.col("first.rid").alias("cid"), "first.doc_id", "first.tid", "n", "class_id"), "classes")

    links = _links(docs, rows, classes, size, Sizes(percent))
    joined = components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n_links"))
    known = classes.select("cls", "cid", "class_id").join(counts, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.withColumn("component", F.coalesce("component", "cid"))
    smallest = known.groupBy("component").agg(F.min("class_id").alias("component_id"))
    known = known.join(smallest, "component").select("cls", "class_id", "n_links", "component_id")
    out = rows.select("doc_id", "n_shingles", "cls").join(known, "cls", "left")
    own = lambda c: F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", "n_shingles", own("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), own("component_id"))


def _postings(rows: DataFrame, classes: DataFrame, sizes: Sizes) -> DataFrame:
    """(gram, cid, n, place, length): the prefix of each class, in lists of two classes or more."""
    drawn = rows.select("rid", F.explode("drawn").alias("gram"))
    counts = drawn.groupBy("gram").agg(F.count("*").alias("rows")).filter("rows > 1")
    shared = drawn.join(counts, "gram").join(classes.select(F.col("cid").alias("rid"), "n"), "rid")
    mine = W.partitionBy("rid")
    shared = shared.withColumns({"k": F.row_number().over(mine.orderBy("rows", "gram")), "of": F.count("*").over(mine)})
    n = F.col("n")
    # Those that nobody shares are the rarest, and stand before.
    shared = shared.withColumn("place", sizes.drawn(n) - F.col("of") + F.col("k") - 1).filter(F.col("place") < sizes.prefix(n))
    shared = materialize(shared.select("gram", F.col("rid").alias("cid"), "n", "place"), "prefixes")
    lengths = shared.groupBy("gram").agg(F.count("*").alias("length")).filter("length > 1")
    postings = materialize(shared.join(lengths, "gram"), "postings")
    discard(shared)
    return postings


def _links(docs: DataFrame, rows: DataFrame, classes: DataFrame, size: int, sizes: Sizes) -> DataFrame:
    """(a, b, n): classes with links, how many those are, and a class connected with each; several rows for one class."""
    percent = sizes.percent
    postings = _postings(rows, classes, sizes)
    bins = rows.select(F.col("rid").alias("cid"), "bins")

    # Families: what long lists connect.
    long = postings.filter(F.col("length") > _SHORT)
    heads = long.groupBy("gram").agg(F.min("cid").alias("a"))
    families = components(long.join(heads, "gram").select("a", F.col("cid").alias("b")).distinct())
    families = materialize(families.select(F.col("node").alias("cid"), F.col("component").alias("family")).join(classes.select("cid", "n"), "cid"), "families")

    # Pairs of short lists, unless a family has both.
    short = postings.filter(F.col("length") <= _SHORT).select("gram", "cid", "n", (sizes.drawn(F.col("n")) - F.col("place")).alias("left"), sizes.shared(F.col("n")).alias("least"))
    one, two = (short.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("cid", "n", "left", "least")]) for s in "ab")
    fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.least("left_a", "left_b") >= F.least("least_a", "least_b"))
    pairs = one.join(two, "gram").filter("cid_a < cid_b").filter(fits).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"), "n_a", "n_b").distinct()
    for s in "ab":
        pairs = pairs.join(families.select(F.col("cid").alias(s), F.col("family").alias(f"family_{s}")), s, "left")
    pairs = pairs.filter("family_a is null or family_b is null or family_a != family_b")
    for s in "ab":
        pairs = pairs.join(bins.select(F.col("cid").alias(s), F.col("bins").alias(f"bins_{s}")), s)
    apart = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    pairs = pairs.filter(apart <= F.col("n_a") + F.col("n_b") - 2 * sizes.overlap(F.col("n_a"), F.col("n_b")))
    pairs = materialize(pairs.select("a", "b", "n_a"), "pairs")

    star = pairs.groupBy("a").agg(F.ceil(F.count("*") * F.max("n_a") / _BLOCK_GRAMS).alias("parts"))
    cell = lambda side, cid: [F.col("a").alias("family"), F.lit(-1).cast("long").alias("left_band"), F.col("part").alias("left"), F.lit(-2).cast("long").alias("right_band"), F.col("part").alias("right"), F.lit(side).alias("side"), F.col(cid).alias("cid")]
    rim = pairs.join(star, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select(*cell(1, "b"))
    centres = star.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(*cell(0, "a"))

    blocks = _blocks(families, percent)
    dealt = lambda df: df.repartition(*_CELL).sortWithinPartitions(*_CELL, "side", "cid")
    screened = blocks.join(bins, "cid").select(*_CELL, "side", "cid", "bins")
    near = dealt(screened).mapInArrow(_screen(percent), ", ".join(f"{c} long" for c in _CELL) + ", side int, cid long")
    cells = materialize(near.unionByName(rim).unionByName(centres), "cells")

    wanted = cells.select("cid").distinct().join(classes.select("cid", "doc_id", "tid"), "cid")
    wanted = materialize(wanted.select("cid", F.col("doc_id").alias("of_id"), F.col("tid").alias("of_tid")), "wanted")
    if wanted.count() <= _BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, (docs["tid"] == wanted["of_tid"]) & docs["doc_id"].eqNullSafe(wanted["of_id"]))
    sets = materialize(texts.select("cid", "text").mapInArrow(_sets(size), "cid long, grams binary"), "grams")
    links = dealt(cells.join(sets, "cid").select(*_CELL, "side", "cid", "grams")).mapInArrow(_verify(percent), "a long, b long, n long")
    return materialize(links, "links")


def _blocks(families: DataFrame, percent: int) -> DataFrame:
    """(cell, side, cid): which blocks each class of a family stands in; every two classes of similar size meet in one cell.

    Sizes of similar sets are in the same band or in neighbouring ones (bands are a little wider than
    the similarity asks for, to be safe from rounding). A family that fits one block has one band.
    """
    whole = families.groupBy("family").agg(F.sum("n").alias("grams"), F.count("*").alias("members"))
    small = (F.col("grams") <= _BLOCK_GRAMS) & (F.col("members") <= _BLOCK_CLASSES)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.1 / percent)))
    placed = families.join(whole, "family").select("family", "cid", "n", F.when(small, 0).otherwise(band).cast("long").alias("band"))
    sizes = placed.groupBy("family", "band").agg(F.ceil(F.greatest(F.sum("n") / _BLOCK_GRAMS, F.count("*") / _BLOCK_CLASSES)).alias("blocks"))
    sizes = materialize(sizes, "bands")
    mine = materialize(placed.join(sizes, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks"))).select("family", "band", "block", "blocks", "cid"), "placed")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias("other")
    inside = mine.select("family", "band", "block", "cid", every("blocks"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    inside = inside.select("family", F.col("band").alias("left_band"), low.alias("left"), F.col("band").alias("right_band"), high.alias("right"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "cid")
    beside = sizes.select("family", F.col("band").alias("next_band"), F.col("blocks").alias("next_blocks"))

    def next_to(step: int) -> DataFrame:
        met = mine.join(beside.withColumn("band", F.col("next_band") - step), ["family", "band"])
        met = met.select("family", "band", "next_band", "block", "cid", every("next_blocks"))
        mine_, theirs = [F.col("band"), F.col("block")], [F.col("next_band"), F.col("other")]
        (lb, li), (rb, ri) = (mine_, theirs) if step > 0 else (theirs, mine_)
        return met.select("family", lb.alias("left_band"), li.alias("left"), rb.alias("right_band"), ri.alias("right"), F.lit(0 if step > 0 else 1).alias("side"), "cid")

    return inside.unionByName(next_to(1)).unionByName(next_to(-1))
