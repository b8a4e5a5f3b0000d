"""Near-duplicate documents by bottom-k sketches from one hash function.

Every document becomes the set of its word shingles, hashed to 64 bits by one function. Its
*sketch* is the k smallest hashes. The plan:

1.  Documents with equal sets form a class, known by a fingerprint of the set; one document
    stands for it, so thousands of copies cost one row.
2.  Inverted lists: each sketch is posted under every few neighbouring retained values taken
    together (see _tiers). One value alone is shared by everyone who uses a common phrase;
    neighbouring values are shared only if nothing retained falls between them in either set.
3.  The pairs of a long list are never listed. Each list has a hub, the class whose values occur most
    often (in a family of copies, the one least changed). Every class is paired with the hubs of its
    lists; the sketch of the union (the k smallest of both) estimates the similarity, pairs more
    than `_MARGIN` below the threshold are dropped (over 5 standard deviations), and the rest are
    confirmed on whole sets, read again from the texts.
4.  Two classes that share a list share its hub. So only classes that are not in their hub's
    component can still have links that matter; blocks of them are indexed by shingle and compared,
    on whole sets, with blocks of all classes of that hub that are of about their size. That finds
    every link between two components: no cap, no loss, and only links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import SpanHasher, lower_ascii, materialize, mix, row_slices, split_at, text_buffer, word_spans
from undertow.llm.components import components

_MARGIN = 0.25
#: Texts checked against one star's centre by one task.
_STAR_PART = 400
#: Classes outside their hub's component that one task compares with others.
_BLOCK = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """(row bounds, hashes): the sorted distinct shingle hashes of each row, one row after another."""
    low = lower_ascii(data)
    start, end = word_spans(low)
    n_rows = len(offsets) - 1
    if not len(start):
        return np.zeros(n_rows + 1, np.int64), np.zeros(0, np.uint64)
    start, end = split_at(start, end, offsets[1:-1])
    words = SpanHasher(low)(start, end)
    first = np.searchsorted(start, offsets[:-1], side="left")
    last = np.searchsorted(start, offsets[1:], side="left")
    count = last - first
    n = len(words)
    joined = words.copy()
    for j in range(1, size):
        joined[: n - j] = mix(joined[: n - j] * np.uint64(0xD1342543DE82EF95) + words[j:])
    row = np.repeat(np.arange(n_rows), count)
    within = np.arange(n) - first[row]
    good = within <= count[row] - size
    row_full, hashes = row[good], joined[good]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):  # the whole sequence is the one shingle
        whole = np.zeros(len(short), dtype=np.uint64)
        for i, r in enumerate(short):
            value = words[first[r] : first[r] + 1]
            for j in range(first[r] + 1, last[r]):
                value = mix(value * np.uint64(0xD1342543DE82EF95) + words[j : j + 1])
            whole[i : i + 1] = mix(value + count[r : r + 1].astype(np.uint64))
        row_full, hashes = np.concatenate((row_full, short)), np.concatenate((hashes, whole))
    by = np.lexsort((hashes, row_full))
    row_full, hashes = row_full[by], hashes[by]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row_full[1:] != row_full[:-1])
    row_full, hashes = row_full[fresh], hashes[fresh]
    return np.searchsorted(row_full, np.arange(n_rows + 1)), hashes


_SKETCH = "doc_id long, tid binary, n_shingles long, cls long, sketch array<long>"


def _sketch(size: int, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b in row_slices(offsets):
                bounds, hashes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                count = np.diff(bounds)
                prints = np.zeros(len(hashes) + 1, dtype=np.uint64)
                np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=prints[1:])
                cls = mix(prints[bounds[1:]] - prints[bounds[:-1]] + count.astype(np.uint64))
                kept = np.minimum(count, k)
                at = np.repeat(bounds[:-1] - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())
                sketch = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))).astype(np.int32)), pa.array(hashes[at].view(np.int64)))
                cls_column = pa.array(cls.view(np.int64), mask=count == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(count), cls_column, sketch], names=["doc_id", "tid", "n_shingles", "cls", "sketch"])

    return task


def _tiers(percent: int) -> tuple[tuple[int, int, int], ...]:
    """(run, least, most): sets of least to most shingles are posted under runs of that many values.

    Similar sets always share a tier, as their sizes differ by a fifth at most. Within a tier too
    few values can differ for every run to be broken, if the set is its own sketch; above, with a
    sketch of 64, the chance that every run is broken is 1e-6 at the threshold and falls from there.
    """
    return (2, 1, 8), (3, 6, 24), (5 if percent >= 85 else 4, 18, 1 << 62)


def _post(tiers: tuple[tuple[int, int, int], ...]):
    """(cls, n, sketch) to (key, cls, n): one row for each run of neighbouring retained values."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy().view(np.uint64)
            bounds = np.asarray(lists.offsets).astype(np.int64)
            bounds = bounds - bounds[0]
            count, size = np.diff(bounds), batch.column(1).to_numpy()
            row = np.repeat(np.arange(len(count)), count)
            within = np.arange(len(values)) - bounds[row]
            for run, least, most in tiers:
                keys = values + np.uint64(run)
                for j in range(1, run):
                    keys[: len(keys) - j] = mix(keys[: len(keys) - j] * np.uint64(0x9E3779B97F4A7C15) + values[j:])
                good = (within <= count[row] - run) & (size[row] >= least) & (size[row] <= most)
                rows = pa.array(row[good])
                yield pa.RecordBatch.from_arrays([pa.array(keys[good].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["key", "cls", "n"])

    return task


def _estimate(k: int, least: float):
    """Keep the pairs (a, b) whose union sketch puts the similarity at `least` or more."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            lo, ro = np.asarray(left.offsets), np.asarray(right.offsets)
            lv, rv = left.values.to_numpy().view(np.uint64), right.values.to_numpy().view(np.uint64)
            keep = []
            for i in range(batch.num_rows):
                both = np.concatenate((lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]))
                both.sort()
                twice = both[1:] == both[:-1]
                distinct = np.concatenate(([True], ~twice))
                rank = np.cumsum(distinct)
                union = min(k, int(rank[-1]) if len(rank) else 0)
                shared = int(np.count_nonzero(twice & (rank[1:] <= union)))
                if union and shared >= least * union:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return task


def _confirm(size: int, percent: int):
    """Rows sorted by (star, part, centre first): emit (a, b) where the whole sets are similar."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(4))
            stars, parts, classes, is_centre = (batch.column(k).to_pylist() for k in range(4))
            out: list[tuple[int, int]] = []
            for a, b in row_slices(offsets):
                bounds, hashes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                for i in range(a, b):
                    own = hashes[bounds[i - a] : bounds[i - a + 1]]
                    if is_centre[i]:
                        star, centre = (stars[i], parts[i]), own.copy()
                    elif star == (stars[i], parts[i]):
                        at = np.minimum(np.searchsorted(centre, own), max(len(centre) - 1, 0))
                        shared = int(np.count_nonzero(centre[at] == own)) if len(centre) and len(own) else 0
                        if shared and 100 * shared >= percent * (len(centre) + len(own) - shared):
                            out.append((stars[i], classes[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return task


def _cross(size: int, percent: int):
    """Rows sorted by (hub, band, block, part, role): link the outliers (role 0) with the members (role 1) of each task.

    Only classes of different components are linked, and one link for each two components is enough.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pending, table = None, [], None
        done: set[tuple[int, int]] = set()

        def indexed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Sorted hashes of all outliers, whose they are, and the size of each one's set."""
            hashes = np.concatenate([x[2] for x in pending])
            owner = np.repeat(np.arange(len(pending)), [len(x[2]) for x in pending])
            by = np.argsort(hashes, kind="stable")
            return hashes[by], owner[by], np.array([len(x[2]) for x in pending])

        for batch in batches:
            data, offsets = text_buffer(batch.column(7))
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            roles, classes, comps = (batch.column(k).to_pylist() for k in (4, 5, 6))
            out: list[tuple[int, int]] = []
            for a, b in row_slices(offsets):
                bounds, hashes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                for i in range(a, b):
                    own = hashes[bounds[i - a] : bounds[i - a + 1]]
                    if keys[i] != key:
                        key, pending, table, done = keys[i], [], None, set()
                    if roles[i] == 0:
                        pending.append((classes[i], comps[i], own.copy()))
                        continue
                    if not pending:
                        continue
                    if table is None:
                        table = indexed()
                    low, high = np.searchsorted(table[0], own, "left"), np.searchsorted(table[0], own, "right")
                    count = high - low
                    at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    shared = np.bincount(table[1][at], minlength=len(pending))
                    for k in np.flatnonzero(100 * shared >= percent * (table[2] + len(own) - shared)):
                        other, comp, _ = pending[k]
                        pair = (min(comp, comps[i]), max(comp, comps[i]))
                        if comp != comps[i] and pair not in done:
                            done.add(pair)
                            out.append((other, classes[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return task


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, k: int = 64) -> DataFrame:
    """Group documents whose sets of `size`-word shingles have a Jaccard similarity of percent / 100 or more.

    docs: doc_id long, text string (other columns are ignored). Words are runs of anything but
    space and \\t to \\r, with A-Z lower-cased. A text with fewer words than `size` has its whole
    word sequence as its one shingle. Returns one row for each input row: doc_id, n_shingles,
    tid (digest of the text), cls (null for texts without words; equal for equal sets), group (equal
    for linked documents, null for texts without words), component_id (the smallest doc_id
    reachable over links, itself included), n_links (similar classes that were confirmed with its
    class; a lower bound, as pairs inside a known component are not all tried) and kept
    (doc_id equals component_id).

    Null or empty text, or one without words: an empty set, linked with nothing. Null doc_id: the
    row takes the component of its group (null if no member has an id) and is kept only then.
    Repeated rows: each comes back. Empty input: empty output.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent is 80 to 100: below, runs of retained values need not be shared")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tid", F.unhex(F.md5("text")))
    rows = materialize(docs.select("doc_id", "tid", "text").mapInArrow(_sketch(size, k), _SKETCH), "sketches")
    links = _links(docs, rows, size, percent, k)
    joined = components(links)

    owners = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"))
    known = owners.join(joined, owners["cls"] == joined["node"], "left").select("cls", "first_id", F.coalesce("component", "cls").alias("component"))
    smallest = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(smallest, "component").select("cls", "component", "component_id")
    counts = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    known = known.join(counts, "cls", "left")
    out = rows.select("doc_id", "tid", "n_shingles", "cls").join(known, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "tid", "n_shingles", "cls", F.col("component").alias("group"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (any columns beside doc_id and text) without near duplicates.

    Of each group the document with the smallest doc_id stays (of equal or null ids, the one with
    the smallest digest of its text). Texts without words all stay. Rows with equal doc_id and text
    count as one document and leave one row.
    """
    near = near_duplicates(docs, size=size, percent=percent)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid")
    first = near.filter("group is not null").groupBy("group").agg(F.min(order).alias("k")).select("k.doc_id", "k.tid")
    first = first.unionByName(near.filter("group is null").select("doc_id", "tid").distinct())
    rows = near.groupBy("doc_id", "tid").agg(F.count("*").alias("rows"))
    same = first["doc_id"].eqNullSafe(rows["doc_id"]) & (first["tid"] == rows["tid"])
    keys = materialize(first.join(rows, same).select(first["doc_id"].alias("key_id"), first["tid"].alias("key_tid"), "rows"), "kept")
    tid = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))

    def matching(wanted: DataFrame) -> DataFrame:
        return docs.join(wanted, F.col("doc_id").cast("long").eqNullSafe(F.col("key_id")) & (tid == F.col("key_tid")), "left_semi")

    repeated = matching(keys.filter("rows > 1"))
    return matching(keys.filter("rows = 1")).unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def _links(docs: DataFrame, rows: DataFrame, size: int, percent: int, k: int) -> DataFrame:
    """Confirmed pairs of classes, enough of them to connect every component."""
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid")).alias("lead")
    classes = rows.filter("cls is not null").groupBy("cls").agg(lead, F.any_value("n_shingles").alias("n"))
    sketches = rows.filter("cls is not null").dropDuplicates(["cls"]).select("cls", F.col("n_shingles").alias("n"), "sketch")
    postings = sketches.select("cls", "n", "sketch").mapInArrow(_post(_tiers(percent)), "key long, cls long, n long")
    lengths = postings.groupBy("key").agg(F.count("*").alias("length")).filter("length > 1")
    postings = materialize(postings.join(lengths, "key"), "postings")
    score = postings.groupBy("cls").agg(F.sum("length").alias("score"))
    involved = materialize(sketches.join(score, "cls"), "involved")

    def with_text(uses: DataFrame, columns: list[str]) -> DataFrame:
        """Rows with a cls, and the text that stands for it."""
        wanted = uses.join(classes.select("cls", "lead.doc_id", "lead.tid"), "cls").groupBy("tid", "doc_id").agg(F.collect_list(F.struct(*columns)).alias("uses"))
        at = (docs["tid"] == wanted["tid"]) & docs["doc_id"].eqNullSafe(wanted["doc_id"])
        texts = docs.join(wanted, at).select(F.explode("uses").alias("use"), "text")
        return texts.select(*[F.col(f"use.{c}").alias(c) for c in columns], "text")

    scored = postings.join(score, "cls")
    hub = scored.groupBy("key").agg(F.max(F.struct("score", "cls", "n")).alias("hub"))
    families = postings.join(hub, "key").select(F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n"), "cls", "n").distinct()
    families = materialize(families, "families")

    # Stars: each class against the hub of its lists.
    pairs = families.filter("cls != hub").filter((F.least("n", "hub_n") * 100) >= (F.greatest("n", "hub_n") * percent))
    side = involved.select("cls", "sketch")
    pairs = pairs.select(F.col("hub").alias("a"), F.col("cls").alias("b")).join(side.select(F.col("cls").alias("a"), F.col("sketch").alias("sa")), "a").join(side.select(F.col("cls").alias("b"), F.col("sketch").alias("sb")), "b")
    pairs = materialize(pairs.select("a", "b", "sa", "sb").mapInArrow(_estimate(k, max(percent / 100 - _MARGIN, 0.0)), "a long, b long"), "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / _STAR_PART).alias("parts"))
    rim = pairs.join(parts, "a").select(F.col("a").alias("star"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("cls"), F.lit(False).alias("centre"))
    centres = parts.select(F.col("a").alias("star"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("cls"), F.lit(True).alias("centre"))
    texts = with_text(rim.unionByName(centres), ["star", "part", "cls", "centre"])
    texts = texts.repartition("star", "part").sortWithinPartitions("star", "part", F.desc("centre"))
    first = materialize(texts.mapInArrow(_confirm(size, percent), "a long, b long").distinct(), "stars")
    done = components(first)

    # Families in several components: what the star left out against everybody of about its size.
    where = lambda c: done.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    placed = families.join(where("cls"), "cls", "left").join(where("hub"), "hub", "left")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent) if percent < 100 else F.lit(2.0)))
    placed = placed.select("hub", "cls", F.coalesce("cls_component", "cls").alias("component"), F.coalesce("hub_component", "hub").alias("main"), band.alias("band"))
    open_ones = placed.filter("component != main")
    members = placed.join(open_ones.select("hub").distinct(), "hub", "left_semi").select("hub", "cls", "component", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    blocks = open_ones.groupBy("hub", "band").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks"))
    sizes = members.join(blocks, ["hub", "band"]).groupBy("hub", "band", "blocks").agg(F.ceil(F.count("*") / (4 * _BLOCK)).alias("parts"))
    sizes = materialize(sizes, "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    rows = ["hub", "band", "block", "part", "role", "cls", "component"]
    outliers = open_ones.join(sizes, ["hub", "band"]).select("hub", "band", mine("blocks").alias("block"), every("parts").alias("part"), F.lit(0).alias("role"), "cls", "component")
    others = members.join(sizes, ["hub", "band"]).select("hub", "band", every("blocks").alias("block"), mine("parts").alias("part"), F.lit(1).alias("role"), "cls", "component")
    texts = with_text(outliers.unionByName(others), rows)
    texts = texts.repartition("hub", "band", "block", "part").sortWithinPartitions("hub", "band", "block", "part", "role")
    rest = materialize(texts.mapInArrow(_cross(size, percent), "a long, b long").distinct(), "crossed")
    return first.unionByName(rest)
