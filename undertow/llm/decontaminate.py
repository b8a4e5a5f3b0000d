"""Benchmark decontamination by latent semantic retrieval.

1.  Every document is cut into passages of `_PASSAGE` words. A passage's vector holds TF-IDF
    weights of the benchmark's words (other words have no part in a similarity to an item). The idf
    comes from all passages.
2.  A randomised SVD of the passage matrix A: with a random matrix W of few columns, Y = A'(A W) is
    summed over the passages of every task and then over tasks; Q, an orthogonal base of Y, goes
    through the passages once more, and the small matrix (A Q)'(A Q) gives the leading right
    singular vectors. Texts are cut into words once; their benchmark words are stored as numbers.
    Only matrices of benchmark words by a few columns more than `rank` reach the driver.
3.  Windows of every text, about as long as the items, meet an item through its rarest words: of
    these, so many are taken that a window with fewer than `_MEET` of them around it can't reach
    `least_coverage`. Those that meet are projected, and with a cosine of `least_cosine` to the
    item they become candidates.
4.  A candidate is confirmed on the words around it: the longest common subsequence with the item
    must cover `least_coverage` of the item, and where the benchmark has an answer for the item,
    that with the answer half of it. Subsequences allow for inserted, dropped and replaced words.

The benchmark goes in blocks of `_BLOCK` items, so what is sent to every task has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import SpanHasher, lower_ascii, materialize, row_slices, split_at, text_buffer, trimmed, word_spans

_PASSAGE = 64
_BLOCK = 2000
#: So many of an item's rarest words must stand around a window that is compared with it.
_MEET = 3
_FOUND, _TEXT = "_leaks_found", "_leaks_text"


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each word, hash of each word), lower-cased and without punctuation at the sides."""
    low = lower_ascii(data)
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start, end = trimmed(low, *split_at(*word_spans(low), bounds[1:-1]))
    real = end > start
    start, end = start[real], end[real]
    return np.searchsorted(bounds, start, side="right") - 1, SpanHasher(low)(start, end)


def _hash_text(text: str) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return _words(data, np.array([0, len(data)]))[1]


@dataclass(frozen=True)
class _Items:
    """One block of the benchmark."""

    ids: list[int | None]
    words: list[np.ndarray]  # vocabulary numbers
    answers: list[np.ndarray]
    vocabulary: np.ndarray  # sorted hashes

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[at] == hashes, at, -1) if len(self.vocabulary) else np.full(len(hashes), -1)


def _items(rows: list) -> _Items:
    hashes = [_hash_text(r["text"]) for r in rows]
    answers = [_hash_text(r["answer"]) for r in rows]  # empty where there is none
    vocabulary = np.unique(np.concatenate([*hashes, *answers, np.zeros(0, np.uint64)]))
    empty = _Items([], [], [], vocabulary)
    kept = [k for k, h in enumerate(hashes) if len(h)]
    return _Items([rows[k]["item_id"] for k in kept], [empty.numbers(hashes[k]) for k in kept], [empty.numbers(answers[k]) for k in kept], vocabulary)


_TOKENS = {"_leaks_places": "array<int>", "_leaks_terms": "array<int>", "_leaks_words": "int"}
_INTS = pa.list_(pa.int32())


def _tokenise(items: _Items, text_at: str, carried: list[str]):
    """Rows to their carried columns, the places and numbers of the benchmark words in the text, and its number of words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text_at)))
            for a, b in row_slices(offsets):
                row, hashes = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                number = items.numbers(hashes)
                hit = np.flatnonzero(number >= 0)
                first = np.searchsorted(row, np.arange(b - a + 1), side="left")
                bounds = pa.array(np.searchsorted(hit, first).astype(np.int32))
                place = hit - first[row[hit]]
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (place, number[hit])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in carried), *lists, pa.array(np.diff(first).astype(np.int32))], names=[*carried, *_TOKENS])

    return task


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of lists without nulls."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    return offsets - offsets[0], np.asarray(column.values)[offsets[0] : offsets[-1]]


def _passages(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passage, term, count) for some texts at a time, ordered by passage."""
    offsets, places = _lists(batch.column(0))
    terms = _lists(batch.column(1))[1]
    for a, b in row_slices(offsets, 1 << 17):
        part = slice(offsets[a], offsets[b])
        if offsets[a] == offsets[b]:
            continue
        text = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        raw = (text << 32) + places[part] // _PASSAGE
        passage = np.concatenate(([0], np.cumsum(raw[1:] != raw[:-1])))
        key, count = np.unique((passage << 32) | terms[part], return_counts=True)
        yield key >> 32, key & 0xFFFFFFFF, count


def _document_frequency(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            passages += int(np.sum(-(-batch.column(2).to_numpy() // _PASSAGE)))
            for _, term, _ in _passages(batch):
                total[:size] += np.bincount(term, minlength=size)
        total[size] = passages
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "n"])

    return task


def _images(batches: Iterator[pa.RecordBatch], weight: np.ndarray, right: np.ndarray):
    """(term, value, bounds of the passages, images): the unit vectors of passages and their products with right."""
    right = right.astype(np.float32)
    for batch in batches:
        for passage, term, count in _passages(batch):
            value = count * weight[term]
            first = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
            sizes = np.diff(np.concatenate((first, [len(passage)])))
            value = (value / np.repeat(np.sqrt(np.add.reduceat(value**2, first)), sizes)).astype(np.float32)
            yield term, value, sizes, np.add.reduceat(right[term] * value[:, None], first, axis=0)


def _sums(tokens: DataFrame, task, key: str, rank: int) -> list:
    """Rows (key, v) of a task, summed by key."""
    parts = tokens.mapInArrow(task, f"{key} long, v array<double>").groupBy(key)
    return parts.agg(F.array(*[F.sum(F.get("v", F.lit(k))) for k in range(rank)]).alias("v")).collect()


def _rows(key: str, index: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(index), pa.array(values.tolist(), pa.list_(pa.float64()))], names=[key, "v"])


def _times_gram(tokens: DataFrame, weight: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'(A right), A being the matrix of all passages' unit vectors; one row for each word of the block reaches the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(right)
        for term, value, sizes, image in _images(batches, weight, right):
            by = np.argsort(term, kind="stable")
            ordered = term[by]
            at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            owner = np.repeat(np.arange(len(sizes)), sizes)[by]
            total[ordered[at]] += np.add.reduceat(image[owner] * value[by][:, None], at, axis=0)
        used = np.flatnonzero(np.abs(total).sum(axis=1) > 0)
        yield _rows("term", used, total[used])

    out = np.zeros_like(right)
    for r in _sums(tokens, task, "term", right.shape[1]):
        out[r["term"]] = r["v"]
    return out


def _small_gram(tokens: DataFrame, weight: np.ndarray, base: np.ndarray) -> np.ndarray:
    """(A base)'(A base), of the base's width."""
    rank = base.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank))
        for _, _, _, image in _images(batches, weight, base):
            total += image.T @ image
        yield _rows("k", np.arange(rank), total)

    out = np.zeros((rank, rank))
    for r in _sums(tokens, task, "k", rank):
        out[r["k"]] = r["v"]
    return out


@dataclass(frozen=True)
class LatentSpace:
    weight: np.ndarray  # idf of each term
    base: np.ndarray  # terms x rank, orthonormal columns


def fit_latent_space(tokens: DataFrame, items: _Items, *, rank: int = 64, oversample: int = 8, seed: int = 0) -> LatentSpace:
    """The leading `rank` right singular vectors of the passage matrix, found among `oversample` more random directions."""
    tokens = tokens.select(*_TOKENS)
    size = len(items.vocabulary)
    df = np.zeros(size + 1)
    for r in tokens.mapInArrow(_document_frequency(size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row for each word of the block
        df[r["term"]] = r["n"]
    n = df[size]
    weight = np.log((1 + n) / (1 + df[:size])) + 0.1
    random = np.random.default_rng(seed).standard_normal((size, max(1, min(rank + oversample, size))))
    base, _ = np.linalg.qr(_times_gram(tokens, weight, random))
    values, vectors = np.linalg.eigh(_small_gram(tokens, weight, base))
    return LatentSpace(weight, base @ vectors[:, np.argsort(-values)[:rank]])


def _common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence with the sequence that masks describes, bit by bit."""
    full = (1 << size) - 1
    row = full
    for w in words:
        if w in masks:
            used = row & masks[w]
            row = ((row + used) | (row - used)) & full
    return size - row.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | (1 << k)
    return out


_MATCH = "array<struct<item_id:bigint,cosine:double,coverage:double,answer:double>>"
_MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("coverage", pa.float64()), ("answer", pa.float64())]))


def _search(items: _Items, space: LatentSpace, least_cosine: float, least_coverage: float):
    terms = [np.unique(w, return_counts=True) for w in items.words]
    vectors = np.stack([(space.weight[t] * c) @ space.base[t] for t, c in terms]) if terms else np.zeros((0, space.base.shape[1]))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    vectors = vectors.astype(np.float32)
    length = np.array([len(w) for w in items.words])
    # The next of 16, 24, 36, ... words.
    window = np.ceil(16 * 1.5 ** np.ceil(np.log(np.maximum(length, 16) / 16) / np.log(1.5))).astype(int) if len(length) else length
    masks = [(_masks(w), len(w), _masks(a), len(a)) for w, a in zip(items.words, items.answers)]
    projected = (space.base * space.weight[:, None]).astype(np.float32)
    # A common subsequence of `need` words leaves out all but `meet` of the item's `taken` rarest words at most.
    need = np.maximum(1, np.ceil(least_coverage * length - 1e-9).astype(int))
    meet = np.minimum(_MEET, need)
    taken = length - need + meet
    keys = {}
    for size in np.unique(window):
        mine = np.flatnonzero(window == size)
        rarest = [np.unique(w[np.argsort(-space.weight[w], kind="stable")[: taken[i]]]) for i, w in ((i, items.words[i]) for i in mine)]
        term, item = np.concatenate(rarest), np.repeat(mine, [len(x) for x in rarest])
        by = np.argsort(term, kind="stable")
        keys[int(size)] = item[by], np.searchsorted(term[by], np.arange(len(space.weight) + 1))

    def candidates(place: np.ndarray, term: np.ndarray, hits: np.ndarray, count: np.ndarray):
        """(text, item, window start, window size, cosine) for the places and numbers of each text's benchmark words.

        hits: bounds of the texts in place and term; count: words of each text.
        """
        owner = np.repeat(np.arange(len(count)), np.diff(hits))
        inside_text = (owner << 32) | place
        for size, (item, at) in keys.items():
            step = size // 4
            last = np.maximum(0, -(-(count - size) // step))  # number of each text's last window
            base = np.concatenate(([0], np.cumsum(last + 1)))
            each = at[term + 1] - at[term]
            hit = np.repeat(np.arange(len(term)), each)
            whose = item[np.repeat(at[term], each) + np.arange(len(hit)) - np.repeat(np.cumsum(each) - each, each)]
            # Around a window are the words from half a window before it to half a window behind it.
            inside = place[hit]
            low = np.maximum(0, (inside - size - size // 2) // step + 1)
            high = np.minimum((inside + size // 2) // step, last[owner[hit]])
            n = np.maximum(0, high - low + 1)
            near = np.repeat(base[owner[hit]] + low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair, met = np.unique(near * len(length) + np.repeat(whose, n), return_counts=True)
            pair = pair[met >= meet[pair % len(length)]]
            seen, which = np.unique(pair // len(length), return_inverse=True)
            text = np.searchsorted(base, seen, side="right") - 1
            start = (seen - base[text]) * step
            low = np.searchsorted(inside_text, (text << 32) | start)
            sizes = np.searchsorted(inside_text, (text << 32) | (start + size)) - low
            for a in range(0, len(seen), 5000):
                part = slice(a, a + 5000)
                vector = np.zeros((len(seen[part]), projected.shape[1]), np.float32)
                full = np.flatnonzero(sizes[part] > 0)
                if len(full):
                    into = np.cumsum(sizes[part][full]) - sizes[part][full]
                    every = np.repeat(low[part][full] - into, sizes[part][full]) + np.arange(sizes[part].sum())
                    vector[full] = np.add.reduceat(projected[term[every]], into, axis=0)
                vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-9)
                mine = slice(np.searchsorted(which, a), np.searchsorted(which, a + 5000))
                cosine = np.einsum("ij,ij->i", vector[which[mine] - a], vectors[pair[mine] % len(length)])
                for x in np.flatnonzero(cosine >= least_cosine).tolist():
                    w = int(which[mine][x])
                    yield int(text[w]), int(pair[mine][x] % len(length)), int(start[w]), size, float(cosine[x])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_leaks_places")
            offsets, places = _lists(batch.column(at))
            terms, counts = _lists(batch.column(at + 1))[1], batch.column(at + 2).to_numpy().astype(np.int64)
            places = places.astype(np.int64)
            matches: list[dict[int, tuple]] = [{} for _ in range(batch.num_rows)]
            for a, b in row_slices(offsets, 1 << 17) if len(items.ids) else ():
                place, term, hits = places[offsets[a] : offsets[b]], terms[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for text, item, start, size, cosine in candidates(place, term, hits, counts[a:b]):
                    mine = place[hits[text] : hits[text + 1]]
                    low, high = np.searchsorted(mine, (start - size // 2, start + size + size // 2)) + hits[text]
                    words = term[low:high].tolist()
                    item_masks, item_size, answer_masks, answer_size = masks[item]
                    coverage = _common_subsequence(item_masks, item_size, words) / item_size
                    if coverage < least_coverage:
                        continue
                    answer = _common_subsequence(answer_masks, answer_size, words) / answer_size if answer_size else None
                    if (answer is None or answer >= 0.5) and (coverage, cosine) > matches[a + text].get(item, (0.0,))[:2]:
                        matches[a + text][item] = (coverage, cosine, answer)
            lists = [[{"item_id": items.ids[i], "cosine": c, "coverage": v, "answer": w} for i, (v, c, w) in sorted(m.items())] for m in matches]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(lists, _MATCH_ARROW)], names=[*batch.schema.names[:at], _FOUND])

    return task


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, carry: list[str] | None = None, rank: int = 64, least_cosine: float = 0.6, least_coverage: float = 0.7) -> DataFrame:
    """Add `matches` to every row: the benchmark items that its text holds.

    docs: text and any other columns; benchmark: item_id long, text, and optionally answer. carry
    names the columns of docs that come back (all by default, text included); a column named
    matches is replaced. matches is an array of struct<item_id, cosine, coverage, answer>, empty
    for a clean text; answer is null where the benchmark has none. Null or empty texts match
    nothing; long texts are searched whole; items without words are never found; items or
    documents that repeat are each judged; null ids are kept. Empty docs or benchmark: no matches.
    """
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    blocks = max(1, -(-bench.count() // _BLOCK))
    carried = [c for c in (docs.columns if carry is None else carry) if c not in ("matches", _FOUND, _TEXT, *_TOKENS)]
    texts = docs.select(*carried, F.col("text").cast("string").alias(_TEXT))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*carried).schema)
    types = f"{types}, " if types else ""
    token_types = ", ".join(f"{k} {v}" for k, v in _TOKENS.items())
    out = None
    for block in range(blocks):
        rows = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        items = _items(sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or "")))
        if not items.ids:
            continue
        # The first block's rows carry the columns, the later ones their matches so far as well.
        source = texts.withColumn("matches", F.array().cast(_MATCH)) if out is None else out
        here = [*carried, "matches", *([_TEXT] if blocks > 1 else [])]
        kept = f"{types}matches {_MATCH}" + (f", {_TEXT} string" if blocks > 1 else "")
        tokens = materialize(source.mapInArrow(_tokenise(items, _TEXT, here), f"{kept}, {token_types}"), "tokens")
        space = fit_latent_space(tokens, items, rank=rank)
        found = tokens.mapInArrow(_search(items, space, least_cosine, least_coverage), f"{kept}, {_FOUND} {_MATCH}")
        out = found.withColumn("matches", F.concat("matches", _FOUND)).drop(_FOUND)
    if out is None:
        out = texts.withColumn("matches", F.array().cast(_MATCH))
    return out.select(*carried, "matches")
