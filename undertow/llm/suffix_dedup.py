"""Removal of byte strings that repeat anywhere in a corpus, by longest-previous-factor arrays.

A text is a string of symbols: its bytes, or, for passages, one code for each word. A *window* is
any `length` consecutive symbols of one text. A window that also starts elsewhere is repeated.

The suffixes of a 100 TB corpus cannot be sorted in one place, so they are first dealt to small
independent groups, and the suffix arrays are built inside those:

1.  Each window picks an *anchor*: the leftmost smallest of the hashes of its short substrings.
    Equal windows pick equal anchors at equal offsets, so they meet in the group of that anchor's
    hash. Neighbouring windows mostly pick the same anchor; such a *run* is one row, its *context*
    the symbols that its windows cover. Runs whose anchor hash is met once cannot hold a repeat.
2.  Runs with the same context hash are copies of each other, so one
    of them stands for all. Copies of whole texts count as one text: what they hold is removed
    because the text is there more than once, whatever the windows tell.
3.  Anchor hashes with several different contexts go, with those contexts' symbols, to buckets of
    bounded size. Each bucket gets a suffix array by prefix doubling to depth `length`. In suffix
    order, the nearest entries before and after with a smaller text position bound the longest
    previous factor: it is the longer of the prefixes shared with these two. Those with a larger
    position give the longest next factor. Factors are cut at `length`.
4.  An anchor hash with more contexts than `_BUCKET_CONTEXTS` would not fit a bucket (a common line
    holds it, say). Its windows reach far to the right or far to the left of the anchor, and equal
    ones agree in that half; so the group is split by side and by the hash of the half. Parts that
    are still too large are counted by Spark, with map-side aggregation: the same result without a
    group in one task. Their windows are first hashed in blocks of neighbours. Contexts that agree
    on all that a block covers repeat the whole block, and one of them stands for all; only where
    different covers share the symbols common to all windows of a block are single windows hashed
    and counted. Inside a common passage that leaves the windows at its edges.
5.  An anchor or a context may have a third of all places: see `_split_join`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import BYTE_CODE, SpanHasher, discard, materialize, mix, powers, row_slices, split_at, text_buffer, word_spans

#: Symbols of the substrings that anchors are chosen from, for texts of bytes and of words.
_SEEDS = {1: 32, 4: 8}
_HOT = 1000
_BUCKET_CONTEXTS = 1024
_BUCKET_SYMBOLS = 1 << 19
_POSITION = np.uint64((1 << 24) - 1)
_LARGEST_SLICE = 1 << 22
#: Neighbouring windows that are first compared as one.
_BLOCK = 16


def _symbols(column: pa.Array, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and offsets of a column of pieces, whose symbols take `unit` bytes each."""
    data, offsets = text_buffer(column)
    return (data, offsets) if unit == 1 else (np.frombuffer(data.tobytes(), np.uint32), offsets // unit)


def _word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One code of 4 bytes for each word of the texts of a buffer, and the texts' offsets among them."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    start, end = split_at(*word_spans(data), offsets[1:-1])
    codes = (SpanHasher(data)(start, end) >> np.uint64(32)).astype(np.uint32)
    return codes, np.searchsorted(start, offsets, side="left")


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of symbols."""
    raw, unit = memoryview(data.tobytes()), data.itemsize
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((start * unit).tolist(), (end * unit).tolist())], dtype=np.uint64)


def _seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the substring from each position on, by doubling."""
    seed = _SEEDS[data.itemsize]
    out, width = BYTE_CODE[data] if data.itemsize == 1 else mix(data.astype(np.uint64) + np.uint64(1)), 1
    base = powers(0xA24BAED4963EE407, seed + 1)
    while width < seed:
        out = out[:-width] * base[width] + out[width:]
        width *= 2
    return mix(out)


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _runs_of_piece(data: np.ndarray, offsets: np.ndarray, length: int):
    """(row, first window, last window, anchor hash, context hash) of each run; positions in the piece."""
    if len(data) < length:
        return None
    seeds = _seed_hashes(data)
    packed = (seeds & ~_POSITION) | np.arange(len(seeds), dtype=np.uint64)
    anchor = (_window_minimum(packed, length - _SEEDS[data.itemsize] + 1) & _POSITION).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, dtype=np.int32)
    starts, ends = offsets[:-1], offsets[1:] - length + 1
    long_enough = ends > starts
    np.add.at(inside, starts[long_enough], 1)
    np.add.at(inside, ends[long_enough], -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(windows):
        return None
    picked = anchor[windows]
    cut = np.flatnonzero((np.diff(picked) != 0) | (np.diff(windows) != 1))
    first = windows[np.concatenate(([0], cut + 1))]
    last = windows[np.concatenate((cut, [len(windows) - 1]))]
    row = np.searchsorted(offsets, first, side="right") - 1
    context = _span_hashes(data, first, last + length)
    return row, first - offsets[row], last - offsets[row], seeds[anchor[first]], context


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, unit: int):
    """Symbols of slices of whole rows; a row of bytes too long for one slice comes in overlapping parts."""
    for a, b in row_slices(offsets):
        size = int(offsets[b] - offsets[a])
        part = data[offsets[a] : offsets[b]]
        if unit > 1:
            yield a, 0, *_word_codes(part, offsets[a : b + 1] - offsets[a])
            continue
        if size <= _LARGEST_SLICE:
            yield a, 0, part, offsets[a : b + 1] - offsets[a]
            continue
        step = _LARGEST_SLICE - length + 1
        for at in range(0, size - length + 1, step):
            piece = part[at : at + _LARGEST_SLICE]
            yield a, at, piece, np.array([0, len(piece)])


_RUN = "tid binary, owner long, first int, last int, anchor long, context long"


def _find_runs(length: int, unit: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, owners = batch.column(0), batch.column(2)
            data, offsets = text_buffer(batch.column(1))
            for row0, at, part, part_offsets in _pieces(data, offsets, length, unit):
                found = _runs_of_piece(part, part_offsets, length)
                if found is None:
                    continue
                row, first, last, anchor, context = found
                yield pa.RecordBatch.from_arrays(
                    [
                        tids.take(pa.array(row + row0)),
                        owners.take(pa.array(row + row0)),
                        pa.array((first + at).astype(np.int32)),
                        pa.array((last + at).astype(np.int32)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(context.view(np.int64)),
                    ],
                    names=["tid", "owner", "first", "last", "anchor", "context"],
                )

    return task


_PIECE = "anchor long, context long, owner long, tid binary, first int, piece binary"


def _cut_pieces(length: int, unit: int):
    """Rows (tid, text, wanted array<struct>) to one row for each wanted run, with its symbols."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            if unit > 1:
                parts = [_word_codes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_slices(offsets)]
                data, offsets = np.concatenate([p[0] for p in parts]), np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))))
            wanted = batch.column(2)
            flat, counts = wanted.flatten(), np.diff(np.asarray(wanted.offsets))
            row = np.repeat(np.arange(len(counts)), counts)
            first, last = (np.asarray(flat.field(k)).astype(np.int64) for k in ("first", "last"))
            raw = data.tobytes()
            starts, ends = (offsets[row] + first) * unit, (offsets[row] + last + length) * unit
            for a in range(0, len(row), 2000):
                b = min(a + 2000, len(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("anchor").slice(a, b - a),
                        flat.field("context").slice(a, b - a),
                        flat.field("owner").slice(a, b - a),
                        batch.column(0).take(pa.array(row[a:b])),
                        pa.array(first[a:b].astype(np.int32)),
                        pa.array([raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())], pa.binary()),
                    ],
                    names=["anchor", "context", "owner", "tid", "first", "piece"],
                )

    return task


def suffix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(width, rank of the suffix at each position in the order of its first `width` symbols), by prefix doubling.

    Widths double from 1 up to `length`. Equal ranks mean equal prefixes. Positions closer to the
    end than a width are ordered as if the lowest symbols followed; callers do not use them.
    """
    n = len(data)
    index_bits = max(1, int(n).bit_length())
    if data.itemsize == 1:
        rank, rank_bits = data.astype(np.uint64), 8
    else:
        names, rank = np.unique(data, return_inverse=True)
        rank, rank_bits = rank.astype(np.uint64), max(1, len(names).bit_length())
    width, levels = 1, [(1, rank.astype(np.uint32))]
    position = np.arange(n, dtype=np.uint64)
    while width < length:
        step = min(width, length - width)
        second = np.zeros(n, dtype=np.uint64)
        if step < n:
            second[: n - step] = rank[step:]
        if width == 1 and data.itemsize == 1:  # two bytes are their own name
            rank, rank_bits = (rank << np.uint64(8)) | second, 16
        else:
            if 2 * rank_bits + index_bits <= 64:
                key = np.sort((((rank << np.uint64(rank_bits)) | second) << np.uint64(index_bits)) | position)
                order = (key & np.uint64((1 << index_bits) - 1)).astype(np.int64)
                pair = key >> np.uint64(index_bits)
                fresh = pair[1:] != pair[:-1]
            else:
                order = np.lexsort((second, rank))
                fresh = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
            named = np.zeros(n, dtype=np.uint64)
            np.cumsum(fresh, out=named[1:])
            rank = np.empty(n, dtype=np.uint64)
            rank[order] = named
            rank_bits = max(1, int(named[-1]).bit_length()) if n else 1
        width += step
        levels.append((width, rank.astype(np.uint32)))
    return levels


def nearest_smaller(values: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry before each one with a smaller value, least of shared on the way); -1 and 0 without any.

    values are distinct; shared[i] belongs to the step from entry i to the one before. All entries
    point to the one before; those that point to a larger value take over its pointer, for all
    that lies between is larger still.
    """
    before, least = np.arange(-1, len(values) - 1), shared.copy()
    open_ = np.arange(1, len(values))
    while len(open_):
        open_ = open_[before[open_] >= 0]
        at = before[open_]
        larger = values[at] > values[open_]
        open_, at = open_[larger], at[larger]
        least[open_] = np.minimum(least[open_], least[at])
        before[open_] = before[at]
    least[before < 0] = 0
    return before, least


def _common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at a and b share, at most the last level's width."""
    length, rank = levels[-1]
    shared = np.where(rank[a] == rank[b], length, 0)
    less = np.flatnonzero(shared == 0)
    for width, rank in levels[-2::-1]:
        fits = less[shared[less] + width < length]
        x, y = a[fits] + shared[fits], b[fits] + shared[fits]
        shared[fits] += np.where(rank[x] == rank[y], width, 0)
    return shared


def longest_factors(levels: list[tuple[int, np.ndarray]], starts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, longest next factor) of the suffixes at starts, cut at the last level's width.

    place: the order of the suffixes in the texts, no two alike. In suffix order, the suffix that
    shares the longest prefix among those of smaller place is the nearest before or the nearest
    behind; with larger places likewise.
    """
    order = np.lexsort((place, levels[-1][1][starts]))
    at, n = starts[order], len(starts)
    step = np.zeros(n, np.int64)  # shared by neighbours in suffix order
    step[1:] = _common_prefix(levels, at[1:], at[:-1])
    back = np.concatenate(([0], step[:0:-1]))
    out = []
    for value in (place[order], -place[order]):
        factor = np.maximum(nearest_smaller(value, step)[1], nearest_smaller(value[::-1], back)[1][::-1])
        placed = np.empty(n, np.int64)
        placed[order] = factor
        out.append(placed)
    return out[0], out[1]


def _ranges(flag: np.ndarray, first: int) -> list[dict]:
    edge = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    return [{"a": first + int(a), "b": first + int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


_PART = "part long, anchor long, context long, owner long, tid binary, first int, piece binary, anchor_at int, lo int, hi int"


def _halves(length: int, unit: int):
    """Contexts of crowded anchors to one row for each side that has windows: part tells anchor, side and half."""
    seed = _SEEDS[unit]
    middle = (length - seed) // 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = batch.column(0).to_numpy().view(np.uint64)
            rows, part, places, lo, hi = [], [], [], [], []
            for k, raw in enumerate(batch.column(5).to_pylist()):
                data = np.frombuffer(raw, np.uint8 if unit == 1 else np.uint32)
                windows = len(data) - length + 1
                # Every window of the run holds the anchor, so it starts no earlier than the last one.
                at = windows - 1 + int(np.flatnonzero(_seed_hashes(data)[windows - 1 :] == anchors[k])[0])
                cut = max(0, min(windows, at - middle))  # windows from here on start at most `middle` before the anchor
                span = lambda a, b: _span_hashes(data[a:b], np.array([0]), np.array([b - a]))  # noqa: B023, E731
                for a, b, half, side in ((0, cut - 1, (at - middle - 1, at + seed), 1), (cut, windows - 1, (at, at + length - middle), 2)):
                    if a <= b:
                        rows.append(k)
                        part.append(mix(span(*half) ^ mix(anchors[k : k + 1] + np.uint64(side)))[0])
                        places.append(at)
                        lo.append(a)
                        hi.append(b)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(part, dtype=np.uint64).view(np.int64)), *(batch.column(c).take(taken) for c in range(6)), *(pa.array(x, pa.int32()) for x in (places, lo, hi))],
                names=["part", "anchor", "context", "owner", "tid", "first", "piece", "anchor_at", "lo", "hi"],
            )

    return task


_HIT = "anchor long, context long, hits array<struct<a:int,b:int>>"


def _bucket_matches(length: int, unit: int, mode: str):
    """Suffix array of one bucket's contexts, and from its factor arrays the repeated windows of each."""

    def task(table: pa.Table) -> pa.Table:
        # A context of two halves of one part is there twice.
        _, once = np.unique(np.stack([table.column("part").to_numpy(), table.column("context").to_numpy()]), axis=1, return_index=True)
        table = table.take(pa.array(np.sort(once))).combine_chunks()
        anchor, context = table.column("anchor").to_numpy(), table.column("context").to_numpy()
        data, offsets = _symbols(table.column("piece").combine_chunks(), unit)
        # Text order: by owner, then text, then position.
        owner = table.column("owner").combine_chunks()
        tid = np.array(table.column("tid").to_pylist(), dtype="S16")
        at = np.lexsort((table.column("first").to_numpy(), tid, owner.fill_null(0).to_numpy(), owner.is_null().to_numpy(zero_copy_only=False)))
        place = np.empty(len(at), dtype=np.int64)
        place[at] = np.arange(len(at))
        lo, hi = table.column("lo").to_numpy().astype(np.int64), table.column("hi").to_numpy()
        sizes = hi - lo + 1
        row = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[row]
        levels = suffix_ranks(data, length)
        starts = offsets[row] + within
        if mode == "others":
            # The extremes of the text numbers among equal windows tell whether another text has one.
            text = np.unique(tid, return_inverse=True)[1][row]
            _, group = np.unique(levels[-1][1][starts], return_inverse=True)
            least, most = np.full(len(starts), len(tid)), np.zeros(len(starts), np.int64)
            np.minimum.at(least, group, text)
            np.maximum.at(most, group, text)
            hit = (least != most)[group]
        else:
            previous, following = longest_factors(levels, starts, (place[row] << 32) | within)
            hit = previous >= length if mode == "first" else (previous >= length) | (following >= length)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        kept = [k for k in range(len(sizes)) if hit[bounds[k] : bounds[k + 1]].any()]
        return pa.table(
            {
                "anchor": pa.array(anchor[kept], pa.int64()),
                "context": pa.array(context[kept], pa.int64()),
                "hits": pa.array([_ranges(hit[bounds[k] : bounds[k + 1]], int(lo[k])) for k in kept], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
            }
        )

    return task


_BLOCK_ROW = "anchor long, context long, owner long, tid binary, first int, block int, lo int, hi int, core long, span long"


def _hash_blocks(length: int, unit: int, size: int):
    """Contexts of crowded parts to one row for each block of up to `size` neighbouring windows.

    Blocks are counted from the anchor, so equal windows stand in equal blocks. core: hash of the
    bytes that all windows of a full block share; span: hash of the bytes that the windows of this
    context cover in the block, and of their place in it.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                data, offsets = _symbols(part.column(5), unit)
                if not len(data):
                    continue
                at, lo, hi = (part.column(c).to_numpy().astype(np.int64) for c in (6, 7, 8))
                least = (lo - at) // size
                sizes = (hi - at) // size - least + 1
                row = np.repeat(np.arange(len(sizes)), sizes)
                block = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + least[row]
                start = at[row] + block * size
                a, b = np.maximum(start, lo[row]), np.minimum(start + size - 1, hi[row])
                base = offsets[row]
                core = _span_hashes(data, base + start + size - 1, base + start + length)
                span = mix(_span_hashes(data, base + a, base + b + length) ^ mix((a - start).astype(np.uint64)))
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(rows) for c in range(5)), *(pa.array(x.astype(np.int32)) for x in (block, a, b)), *(pa.array(x.view(np.int64)) for x in (core, span))],
                    names=["anchor", "context", "owner", "tid", "first", "block", "lo", "hi", "core", "span"],
                )

    return task


_WINDOW = "anchor long, context long, owner long, tid binary, at int, w int, hash long, low_tid binary, high_tid binary"


def _hash_windows(length: int, unit: int):
    """Contexts with the ranges of their windows that are to be compared one by one; a row for each of these windows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                data, offsets = _symbols(part.column(5), unit)
                if not len(data):
                    continue
                lo, hi, ranges = part.column(6).to_numpy(), part.column(7).to_numpy(), part.column(8)
                flat, context = ranges.flatten(), np.repeat(np.arange(len(lo)), np.diff(np.asarray(ranges.offsets)))
                a, b = (np.asarray(flat.field(c)).astype(np.int64) for c in ("lo", "hi"))
                own = np.flatnonzero((a >= lo[context]) & (b <= hi[context]))  # the others are of the context's other half
                context, a, sizes = context[own], a[own], (b - a + 1)[own]
                piece = np.repeat(np.arange(len(sizes)), sizes)
                within = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + a[piece]
                row = context[piece]
                starts = offsets[row] + within
                hashes = _span_hashes(data, starts, starts + length)
                rows, tids = pa.array(row), pa.array(own[piece])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(rows) for c in range(5)),
                        pa.array(within.astype(np.int32)),
                        pa.array(hashes.view(np.int64)),
                        *(flat.field(c).take(tids) for c in ("low_tid", "high_tid")),
                    ],
                    names=["anchor", "context", "owner", "tid", "at", "w", "hash", "low_tid", "high_tid"],
                )

    return task


def _crowd_matches(crowd: DataFrame, length: int, unit: int, mode: str) -> DataFrame:
    """Repeated windows of contexts in parts too large for a bucket: blocks first, then single windows."""
    text_order = (F.col("owner").isNull().alias("last_one"), F.coalesce("owner", F.lit(0)).alias("id"), "tid")
    repeated = F.col("low_tid") != F.col("high_tid") if mode == "others" else F.col("earliest") != F.col("latest")
    blocks = materialize(crowd.mapInArrow(_hash_blocks(length, unit, _BLOCK), _BLOCK_ROW), "blocks")
    key = ["anchor", "block", "core", "span"]
    at = F.struct(*text_order, (F.col("first") + F.col("lo")).alias("p"), "context", "lo", "hi")
    spans = blocks.groupBy(*key).agg(F.min(at).alias("earliest"), F.max(at).alias("latest"), F.min("tid").alias("low_tid"), F.max("tid").alias("high_tid"))
    spans = materialize(spans.withColumn("repeated", repeated), "spans")
    equal = blocks.join(spans.filter("repeated").select(*key, "earliest"), key)
    if mode == "first":
        equal = equal.filter(at != F.col("earliest"))

    # Where other spans have the same core, the earliest context of a repeated span stands for it, and each context of the others for itself.
    mixed = spans.groupBy("anchor", "block", "core").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "block", "core")
    mixed = spans.join(mixed, ["anchor", "block", "core"])
    tids = ("low_tid", "high_tid")
    leads = mixed.filter("repeated").select("anchor", "earliest.context", "earliest.lo", "earliest.hi", *tids)
    single = blocks.join(mixed.filter("not repeated").select(*key, *tids), key).select("anchor", "context", "lo", "hi", *tids)
    leads = leads.unionByName(single).groupBy("anchor", "context").agg(F.collect_set(F.struct("lo", "hi", *tids)).alias("ranges"))
    columns = ["anchor", "context", "owner", "tid", "first", "piece", "lo", "hi", "ranges"]
    windows = crowd.join(leads, ["anchor", "context"]).select(*columns).mapInArrow(_hash_windows(length, unit), _WINDOW)
    at = F.struct(*text_order, (F.col("at") + F.col("w")).alias("p"))
    alike = windows.groupBy("anchor", "hash").agg(F.min(at).alias("earliest"), F.max(at).alias("latest"), F.min("low_tid").alias("low_tid"), F.max("high_tid").alias("high_tid"))
    single = windows.drop(*tids).join(alike.filter(repeated).select("anchor", "hash", "earliest"), ["anchor", "hash"])
    if mode == "first":
        single = single.filter(at != F.col("earliest"))
    found = equal.select("anchor", "context", F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")).alias("hit"))
    found = found.unionByName(single.select("anchor", "context", F.struct(F.col("w").alias("a"), F.col("w").alias("b")).alias("hit")))
    return found.groupBy("anchor", "context").agg(F.collect_set("hit").alias("hits"))


def _split_join(rows: DataFrame, groups: DataFrame, key: list[str], n_rows: int) -> DataFrame:
    """Join rows to their groups. groups: one row for each key, with the number n of its rows.

    At most `_HOT` groups can have more than 1 of `_HOT` of all rows; they are broadcast, so that
    their rows stay where they are. All other groups meet their rows by a shuffle.
    """
    hot = F.broadcast(groups.filter(F.col("n") > n_rows / _HOT))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(groups.filter(F.col("n") <= n_rows / _HOT), key))


def _repeated_windows(texts: DataFrame, length: int, unit: int, mode: str) -> DataFrame:
    """(tid, first, last): ranges of windows that are repeated, by symbols from the start of the text.

    texts: (tid, text, owner), copies included. A window is repeated if it starts earlier ("first"),
    anywhere else ("any") or in a text with another tid ("others").
    """
    found = texts.select("tid", "text", "owner")
    every = materialize(found.mapInArrow(_find_runs(length, unit), _RUN), "runs")
    # Copies of a text have the same tid; they are one place here.
    spot = F.xxhash64("tid") if mode == "others" else F.xxhash64("tid", "first")
    met = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min(spot).alias("low"), F.max(spot).alias("high"))
    met = materialize(met.filter("low != high").select("anchor", "n"), "anchors")
    runs = _split_join(every, met, ["anchor"], every.count()).drop("n")
    if mode == "first":  # copies of a text stand as its first one
        runs = runs.groupBy("anchor", "context", "tid", "first", "last").agg(F.min("owner").alias("owner"))
    runs = materialize(runs, "met")
    discard(every, met)

    place = F.struct(F.col("owner").isNull().alias("last_one"), F.coalesce("owner", F.lit(0)).alias("id"), "tid", "first", "last", "owner")
    repeats = (F.min(spot) != F.max(spot)).alias("repeats")
    contexts = runs.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(place).alias("lead"), repeats)
    contexts = materialize(contexts, "contexts")
    shared = contexts.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    several = contexts.join(shared, "anchor").select("anchor", "context", "kinds", "lead.tid", "lead.owner", "lead.first", "lead.last")
    wanted = several.groupBy("tid", "owner").agg(F.collect_list(F.struct("anchor", "context", "owner", "first", "last")).alias("runs"))
    at_owner = (found["tid"] == wanted["tid"]) & found["owner"].eqNullSafe(wanted["owner"])
    pieces = found.join(wanted, at_owner).select(found["tid"], found["text"], wanted["runs"]).mapInArrow(_cut_pieces(length, unit), _PIECE)
    pieces = materialize(pieces, "pieces")

    total = several.agg(F.sum(F.col("last") - F.col("first") + length).alias("b")).first()["b"] or 0
    buckets = max(1, -(-int(total) // _BUCKET_SYMBOLS))
    crowded = several.filter(F.col("kinds") > _BUCKET_CONTEXTS).select("anchor").distinct()
    whole_run = (F.lit(0).alias("lo"), (F.octet_length("piece") / unit - length).cast("int").alias("hi"))
    columns = ["anchor", "context", "owner", "tid", "first", "piece"]
    small = pieces.join(crowded, "anchor", "left_anti").select(F.col("anchor").alias("part"), *columns, *whole_run)
    halves = pieces.join(crowded, "anchor", "left_semi").select(*columns).repartition("context")
    halves = materialize(halves.mapInArrow(_halves(length, unit), _PART), "halves")
    counts = halves.groupBy("part").agg(F.count("*").alias("rows")).filter("rows > 1")
    halves = halves.join(counts, "part")
    small = small.unionByName(halves.filter(F.col("rows") <= _BUCKET_CONTEXTS).drop("rows", "anchor_at")).withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets)))
    hits = small.groupBy("bucket").applyInArrow(_bucket_matches(length, unit, mode), _HIT)
    crowd = materialize(halves.filter(F.col("rows") > _BUCKET_CONTEXTS).select(*columns, "anchor_at", "lo", "hi").repartition("context"), "crowd")
    matches = hits if crowd.isEmpty() else hits.unionByName(_crowd_matches(crowd, length, unit, mode))

    # A context that is a repeat as a whole: all its places, or all but the first.
    whole = contexts.filter("repeats").select("anchor", "context", "n", F.col("lead").alias("leader"))
    key = ["anchor", "context"]
    n_runs = runs.count()
    copied = _split_join(runs, whole, key, n_runs)
    if mode == "first":
        copied = copied.filter(place != F.col("leader"))
    # The others are alone with their context, together with copies of their text, or repeat it within one text, or are the first.
    alone = contexts.join(whole, key, "left_anti") if mode != "first" else contexts
    if mode == "others":  # all places of the text
        partial = _split_join(runs, materialize(alone.select(*key, "n").join(matches, key), "partial"), key, n_runs)
    else:
        partial = alone.select(*key, "lead.tid", "lead.first").join(matches, key)
    partial = partial.select("tid", "first", F.explode("hits").alias("h"))
    return copied.select("tid", "first", "last").unionByName(partial.select("tid", (F.col("first") + F.col("h.a")).alias("first"), (F.col("first") + F.col("h.b")).alias("last")))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, spans array<struct<start:long,end:long>>"


def _covered(cuts: list[dict] | None, length: int) -> list[list[int]]:
    """Maximal ranges that windows from `first` to `last` cover."""
    spans: list[list[int]] = []
    for first, last in sorted((c["first"], c["last"]) for c in cuts or ()):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    return spans


def _remove(length: int, passage_words: int, with_text: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            raw = data.tobytes()
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "spans", "kept")}
            cuts, passages, whole, copied = (batch.column(c).to_pylist() for c in (2, 3, 4, 5))
            for k in range(batch.num_rows):
                text = raw[offsets[k] : offsets[k + 1]]
                spans = [[0, len(text)]] if whole[k] and len(text) >= length else _covered(cuts[k], length)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                left = b"".join(kept)
                shared = 0
                if passage_words and copied[k]:
                    shared = len(word_spans(data[offsets[k] : offsets[k + 1]])[0])
                    shared = shared if shared >= passage_words else 0
                elif passage_words:
                    shared = sum(b - a for a, b in _covered(passages[k], passage_words))
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(left))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["n_passage_words"].append(shared if passage_words else None)
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                if with_text:
                    out["kept"].append(left)
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_passage_words": pa.int64(), "spans": spans_type, "kept": pa.binary()}
            if not with_text:
                kinds.pop("kept")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], t) for k, t in kinds.items())], names=["doc_id", *kinds])

    return task


def remove_repeats(docs: DataFrame, *, length: int = 400, keep: str = "first", passage_words: int | None = None, with_text: bool = False) -> DataFrame:
    """Remove every byte that a repeated string of `length` bytes covers.

    docs: doc_id long, text string (other columns are ignored). keep="first" leaves the earliest
    copy of each string (texts in order of doc_id, nulls last) and removes the later ones, as the
    previous-factor array tells; keep="none" removes all copies, also the earliest.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (hex digest of what is left),
    n_passage_words (with passage_words: words of the text that stand in a passage of at least so
    many words which a different text holds too, whatever stands between the words, or all words
    if another row has the same text; removes nothing by itself; null without passage_words),
    spans (removed byte ranges, end exclusive) and, if with_text, kept (the bytes that are left,
    which may cut a character in two). One row comes back for each input row, repeated rows included.

    Null or empty text: nothing to remove. Null doc_id: kept as null, counted as the last text.
    Rows with the same doc_id and the same text count as one first copy under keep="first", as two
    copies under keep="none". A text shorter than `length` is never touched; one of any length is
    read whole. Empty input: empty output.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    if length <= _SEEDS[1] or (passage_words or 9) <= _SEEDS[4]:
        raise ValueError(f"length must exceed {_SEEDS[1]}, passage_words {_SEEDS[4]}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tid", F.unhex(F.md5("text")))

    texts = docs.select("tid", "text", F.col("doc_id").alias("owner"))
    jobs = [("cut", texts.filter(F.octet_length("text") >= length), length, 1, "first" if keep == "first" else "any")]
    if passage_words:
        # So many words take at least 2 * passage_words - 1 bytes.
        jobs.append(("passage", texts.filter(F.octet_length("text") >= 2 * passage_words - 1), passage_words, 4, "others"))
    with ThreadPoolExecutor(len(jobs)) as pool:  # their Spark jobs do not depend on each other
        found = list(pool.map(lambda job: (job[0], _repeated_windows(*job[1:])), jobs))
    rows = None
    for name, windows in found:
        part = windows.select("tid", F.lit(name).alias("what"), F.struct("first", "last").alias("range"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("owner"))
        rows = part if rows is None else rows.unionByName(part)
    copies = texts.groupBy("tid").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).filter("n > 1")
    rows = rows.unionByName(copies.select("tid", F.lit("copies").alias("what"), F.lit(None).cast("struct<first:int,last:int>").alias("range"), "n", "owner"))
    of = lambda name: F.collect_set(F.when(F.col("what") == name, F.col("range")))
    cuts = rows.groupBy("tid").agg(of("cut").alias("cuts"), of("passage").alias("passages"), (F.max("n") > 1).alias("copied"), F.max("owner").alias("owner"))
    copied = F.coalesce("copied", F.lit(False))
    whole = copied if keep == "none" else copied & ~F.col("doc_id").eqNullSafe(F.col("owner"))
    joined = docs.join(cuts, "tid", "left").select("doc_id", "text", "cuts", "passages", whole.alias("whole"), copied.alias("copied"))
    schema = _RESULT + (", kept binary" if with_text else "")
    return joined.mapInArrow(_remove(length, passage_words or 0, with_text), schema)
