"""Toxicity with noisy-channel deobfuscation.

1.  A character language model: trigrams over a-z and word bounds, counted over all texts.
2.  Words that may be disguised (symbols among letters, letters spaced out or drawn out) become a
    lattice: each symbol stands for the letters it can replace, each run of a letter for one or
    two of it, separators for nothing or, as gaps between spaced letters, for a word bound. Viterbi decoding under the language model, with the learned
    lexicon mixed in as its most certain words, restores the likeliest spelling.
3.  The text with its restored words is scored by a lexicon of words and word beginnings learnt
    from labels: features seen almost only in toxic documents, chosen by greedy cover so that each
    explains documents that those before it don't. Each present feature speaks with its precision,
    and they combine as independent evidence (noisy or).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import SpanHasher, lower_ascii, row_slices, split_at, text_buffer, trimmed, word_spans

_PREFIXES = (4, 5, 6)
_LEAST_TOXIC = 3
_LEAST_PRECISION = 0.9
_LEAST_NEW = 2
_CODES = 27
#: What a symbol can stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz"}
_SEPARATORS = ".-_ ,;:~'/\\=^`"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LEET_BYTE = np.zeros(256, bool)
_LEET_BYTE[[ord(c) for c in LEET]] = True
_SEPARATOR_BYTE = np.zeros(256, bool)
_SEPARATOR_BYTE[[ord(c) for c in _SEPARATORS.replace(" ", "")]] = True
#: Symbols that disguise a word without letters too; numbers and wildcards alone are left as they are.
_SIGN_BYTE = np.zeros(256, bool)
_SIGN_BYTE[[ord(c) for c in LEET if not c.isdigit() and c not in "*#"]] = True
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)


def _feature_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature): the word itself and its beginnings; equal bytes give equal features."""
    hasher = SpanHasher(data)
    index = np.arange(len(start))
    words, features = [index], [hasher(start, end)]
    for n in _PREFIXES:
        long = np.flatnonzero(end - start >= n)
        words.append(long)
        features.append(hasher(start[long], start[long] + n) ^ np.uint64(0x9E37 * n))
    return np.concatenate(words), np.concatenate(features)


def _suspects(low: np.ndarray, start: np.ndarray, end: np.ndarray, raw_start: np.ndarray, raw_end: np.ndarray, row: np.ndarray) -> list[tuple[int, str, bool]]:
    """(word index, what to decode, whether letters are spaced out) of the words that may be disguised; row: the text of each."""

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[end] - total[start]

    size = end - start
    letter, leet = _LETTER[low], _LEET_BYTE[low]
    drawn = np.zeros(len(low), bool)
    drawn[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
    letters = count(letter)
    odd = ((count(leet) > 0) & (letters > 0)) | (count(drawn) > 0) | ((count(_SEPARATOR_BYTE[low]) > 0) & (letters > 1))
    odd &= size >= 3
    text = lambda a, b: low[a:b].tobytes().decode("utf-8", "replace")
    found = [(int(k), text(start[k], end[k]), False) for k in np.flatnonzero(odd)]
    # Symbols alone, which trimming may have cut.
    total = [np.concatenate(([0], np.cumsum(m))) for m in (leet, _SIGN_BYTE[low])]
    whole, signs = (t[raw_end] - t[raw_start] for t in total)
    bare = (whole == raw_end - raw_start) & (whole >= 3) & (signs > 0)
    found += [(int(k), text(raw_start[k], raw_end[k]), False) for k in np.flatnonzero(bare)]
    single = (raw_end - start <= 2) & (size == 1) & (letter | leet)[np.minimum(start, len(low) - 1)]
    for group in np.split(np.arange(len(row)), np.flatnonzero((single[1:] != single[:-1]) | (row[1:] != row[:-1])) + 1):
        if len(group) >= 3 and single[group[0]]:
            found.append((int(group[0]), bytes(low[start[group]]).decode(), True))
    return found


class Decoder:
    """Viterbi decoding of disguised words under a character trigram model."""

    def __init__(self, trigrams: np.ndarray, lexicon: tuple[str, ...] = ()):
        counts = trigrams.reshape(_CODES, _CODES, _CODES).astype(float) + 0.5
        counts[:, 0, :] = counts.sum(axis=0)[0] / _CODES  # after a bound, only the bound counts
        weight = max(1.0, counts.sum() / 100)
        for word in lexicon:
            codes = [0, 0, *(ord(c) - 96 for c in word if "a" <= c <= "z"), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                counts[a, b, c] += weight / max(1, len(lexicon))
        self.cost = -np.log(counts / counts.sum(axis=2, keepdims=True))
        #: Words of the lexicon by their first letter, and what one of them costs.
        self.known: dict[str, list[str]] = {}
        for word in lexicon:
            if word.isascii() and word.isalpha() and len(word) >= 3:
                self.known.setdefault(word[0], []).append(word)
        self.known_cost = float(np.log(100.0 * max(1, len(lexicon))))
        self._short = lru_cache(maxsize=50_000)(self._decode)
        self._short_words = lru_cache(maxsize=50_000)(self._decode_words)

    def decode(self, token: str) -> str:
        token = token.replace("#", "*")
        return self._short(token) if len(token) <= 64 else self._decode(token)

    def decode_words(self, token: str, spaced: bool) -> list[str]:
        """The likeliest words behind letters that are spaced out, or behind a token that may be split at its separators."""
        token = token.replace("#", "*")
        return self._short_words(token, spaced) if len(token) <= 64 else self._decode_words(token, spaced)

    def _lattice(self, token: str) -> list[tuple[str, ...]]:
        """For each step, the strings it can stand for; "" where it may be nothing."""
        steps: list[tuple[str, ...]] = []
        at = 0
        while at < len(token):
            c = token[at]
            run = 1
            while at + run < len(token) and token[at + run] == c:
                run += 1
            if "a" <= c <= "z":
                steps.append((c,) if run == 1 else (c, c + c))
            elif c in LEET:
                letters = tuple(LEET[c])
                steps.append(letters if run == 1 else tuple(x for a in letters for x in (a, a + a)))
            elif c in _SEPARATORS:
                steps.append(("",))
            else:
                return []
            at += run
        return steps

    def _decode(self, token: str) -> str:
        """The likeliest word behind a token, "" if it holds characters that no word has."""
        steps = self._lattice(token) or [()]
        if all(len(options) == 1 for options in steps):
            return "".join(options[0] for options in steps)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in steps:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            self._step(states, options, new)
            states = new
        best = min(((cost + self.cost[a, b, 0], path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0], default=(0.0, None))
        return self._spelt(best[1])

    @staticmethod
    def _spelt(path: tuple | None) -> str:
        parts = []
        while path is not None:
            path, option = path
            parts.append(option)
        return "".join(reversed(parts))

    def _step(self, states: dict, options: tuple[str, ...], new: dict) -> None:
        for (a, b), (cost, path) in states.items():
            for option in options:
                x, y, total = a, b, cost
                for c in option:
                    code = 0 if c == " " else ord(c) - 96
                    total += self.cost[x, y, code]
                    x, y = (y, code) if code else (0, 0)
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, (path, option))

    def _decode_words(self, token: str, spaced: bool) -> list[str]:
        steps = self._lattice(token)
        if spaced:  # a bound may stand between any two letters
            steps = [p for options in steps for p in (tuple(dict.fromkeys(o for x in options for o in ((x, f"{x[0]} {x[0]}") if len(x) == 2 else (x,)))), ("", " "))][:-1]
        else:
            steps = [("", " ") if options == ("",) else options for options in steps]
        bound = lambda k: k == len(steps) or " " in steps[k]

        def ends(word: str, k: int) -> set[int]:
            """The steps before which a word from step k on may end."""
            at = {(k, 0)}
            done = set()
            while at:
                at = {(i + 1, n + len(o)) for i, n in at if i < len(steps) and n < len(word) for o in steps[i] if word.startswith(o, n)}
                done |= {i for i, n in at if n == len(word) and bound(i)}
            return done

        every: list[dict] = [{} for _ in range(len(steps) + 2)]
        every[0][0, 0] = (0.0, None)
        for k, options in enumerate(steps):
            if (0, 0) in every[k]:
                cost, path = every[k][0, 0]
                for first in {o[0] for o in options if o and o != " "}:
                    for word in self.known.get(first, ()):
                        for i in ends(word, k):
                            total = cost + self.known_cost
                            if (0, 0) not in every[i + 1] or total < every[i + 1][0, 0][0]:
                                every[i + 1][0, 0] = (total, (path, word + " "))
            self._step(every[k], options, every[k + 1])
            every[k] = {}
        last = [(cost + (self.cost[a, b, 0] if (a, b) != (0, 0) else 0.0), path) for (a, b), (cost, path) in every[len(steps)].items()]
        last += [every[len(steps) + 1][0, 0]] if every[len(steps) + 1] else []
        return self._spelt(min(last, key=lambda x: x[0], default=(0.0, None))[1]).split()


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Character trigrams of all texts; whatever is not a-z (after lower-casing) is a bound."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CODES**3, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b in row_slices(offsets):
                code = _CODE[lower_ascii(data[offsets[a] : offsets[b]])]
                if len(code) > 2:
                    total += np.bincount(code[:-2] * _CODES**2 + code[1:-1] * _CODES + code[2:], minlength=len(total))
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], names=["gram", "n"])

    out = np.zeros(_CODES**3, np.int64)
    for r in docs.select("text").mapInArrow(task, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most 27^3 rows
        out[r["gram"]] = r["n"]
    return out


@dataclass(frozen=True)
class Lexicon:
    features: np.ndarray  # sorted hashes
    precision: np.ndarray  # of each
    words: tuple[str, ...]  # the features' spellings, for the decoder
    prior: float  # share of toxic documents among those without a feature


def _document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, text) to one row for each distinct feature of a document, with its spelling."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        for a, b in row_slices(offsets, 1 << 19):
            low = lower_ascii(data[offsets[a] : offsets[b]])
            bounds = offsets[a : b + 1] - offsets[a]
            if not len(low):
                continue
            start, end = trimmed(low, *split_at(*word_spans(low), bounds[1:-1]))
            real = end > start
            start, end = start[real], end[real]
            word, feature = _feature_hashes(low, start, end)
            row = np.searchsorted(bounds, start[word], side="right") - 1
            by = np.lexsort((word, feature, row))
            row, feature, word = row[by], feature[by], word[by]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
            rows = pa.array(row[fresh] + a)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(feature[fresh].view(np.int64))], names=["doc_id", "toxic", "feature"])


def fit_lexicon(docs: DataFrame, labels: DataFrame, *, labelled_rows: int = 20_000) -> Lexicon:
    """Learn the lexicon from labelled documents that are not held out.

    Of more than `labelled_rows` labelled ids, those with the smallest hashes are used; that bound
    also bounds what reaches the driver: the features of toxic ones among them that are precise enough, all of them.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")
    features = sample.mapInArrow(_document_features, "doc_id long, toxic int, feature long")
    counts = features.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).filter((F.col("bad") >= _LEAST_TOXIC) & (F.col("bad") >= _LEAST_PRECISION * F.col("n")))
    table = {r["feature"]: (r["bad"], r["n"]) for r in counts.collect()}
    toxic = sample.filter("toxic = 1").mapInArrow(_document_features, "doc_id long, toxic int, feature long")
    lists = toxic.join(F.broadcast(counts.select("feature")), "feature").groupBy("doc_id").agg(F.collect_set("feature").alias("features")).collect()
    holders: dict[int, set[int]] = {}
    for k, r in enumerate(lists):
        for f in r["features"]:
            holders.setdefault(f, set()).add(k)
    # Greedy: the feature that covers most documents not covered yet. What one would cover only
    # shrinks, so a feature that still leads after it was counted again is the next.
    order_of = lambda f, n: (-n, table[f][1], -f)
    queue = [(order_of(f, len(d)), f) for f, d in holders.items()]
    heapq.heapify(queue)
    chosen: list[int] = []
    done: set[int] = set()
    while queue:
        place, f = heapq.heappop(queue)
        n = len(holders[f] - done)
        if order_of(f, n) != place:
            if n:
                heapq.heappush(queue, (order_of(f, n), f))
            continue
        if n < _LEAST_NEW:
            break
        chosen.append(f)
        done |= holders[f]
    size = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    covered = sum(any(f in set(chosen) for f in r["features"]) for r in lists)
    prior = (max(0, (size["bad"] or 0) - covered) + 0.1) / (size["n"] + 10.0)
    order = sorted(chosen, key=lambda f: f & ((1 << 64) - 1))
    precision = np.array([(table[f][0] + 0.5) / (table[f][1] + 1.0) for f in order])
    words = _spellings(sample.filter("toxic = 1"), order)
    return Lexicon(np.array(order, dtype=np.int64).view(np.uint64), precision, words, prior)


def _spellings(sample: DataFrame, features: list[int]) -> tuple[str, ...]:
    """One spelling of each feature, found again in the toxic sample."""
    wanted = np.array(features, dtype=np.int64).view(np.uint64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b in row_slices(offsets, 1 << 19):
                low = lower_ascii(data[offsets[a] : offsets[b]])
                if not len(low) or not len(wanted):
                    continue
                start, end = trimmed(low, *split_at(*word_spans(low), offsets[a + 1 : b] - offsets[a]))
                real = end > start
                start, end = start[real], end[real]
                word, feature = _feature_hashes(low, start, end)
                hit = np.flatnonzero(np.isin(feature, wanted))
                found = {(int(feature[k]), low[start[word[k]] : end[word[k]]].tobytes().decode("utf-8", "replace")) for k in hit}
                yield pa.RecordBatch.from_arrays([pa.array([np.uint64(f).astype(np.int64) for f, _ in found], pa.int64()), pa.array([w for _, w in found], pa.string())], names=["feature", "word"])

    rows = sample.mapInArrow(task, "feature long, word string").groupBy("feature").agg(F.min_by("word", F.struct(F.length("word"), "word")).alias("word")).collect()
    return tuple(sorted({r["word"] for r in rows}))


def held_out(doc_id):
    """The rows that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def score_texts(docs: DataFrame, lexicon: Lexicon, trigrams: np.ndarray) -> DataFrame:
    """Add score (double) and restored (array of words that were decoded to a feature) to every row."""
    schema = docs.drop("score", "restored")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(trigrams, lexicon.words)
        clean = -np.log1p(-np.minimum(lexicon.precision, 0.98))
        n = len(lexicon.features)

        def matched(feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(lexicon.features, feature), max(n - 1, 0))
            hit = np.flatnonzero(lexicon.features[at] == feature) if n else np.zeros(0, np.int64)
            return hit, at[hit]

        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
            score, restored = np.full(batch.num_rows, lexicon.prior), [[] for _ in range(batch.num_rows)]
            for a, b in row_slices(offsets):
                low = lower_ascii(data[offsets[a] : offsets[b]])
                bounds = offsets[a : b + 1] - offsets[a]
                if not len(low):
                    continue
                raw_start, raw_end = split_at(*word_spans(low), bounds[1:-1])
                start, end = trimmed(low, raw_start, raw_end)
                word, feature = _feature_hashes(low, start, end)
                hit, which = matched(feature)
                rows = np.searchsorted(bounds, start[word[hit]], side="right") - 1
                pairs = {(int(r), int(f)) for r, f in zip(rows, which)}
                row_of = np.searchsorted(bounds, raw_start, side="right") - 1
                for k, token, spaced in _suspects(low, start, end, raw_start, raw_end, row_of):
                    tried = {decoder.decode(token)}
                    if spaced or any(c in _SEPARATORS for c in token):
                        tried.update(decoder.decode_words(token, spaced))
                    row = int(row_of[k])
                    for plain in sorted(w for w in tried if len(w) >= 3):
                        raw = np.frombuffer(plain.encode(), np.uint8)
                        _, own = _feature_hashes(raw, np.array([0]), np.array([len(raw)]))
                        _, found = matched(own)
                        if len(found):
                            restored[a + row].append(plain)
                            pairs |= {(row, int(f)) for f in found}
                total = np.zeros(b - a)
                for r, f in pairs:
                    total[r] += clean[f]
                score[a:b] = 1 - (1 - lexicon.prior) * np.exp(-total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(restored, pa.list_(pa.string()))], names=[*batch.schema.names, "score", "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema)
    return schema.mapInArrow(task, f"{fields}, score double, restored array<string>")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, labelled_rows: int = 20_000) -> DataFrame:
    """Score every document for toxicity as labels.toxic marks it.

    docs: doc_id long, text string, any other columns (kept; held_out, score, restored and
    predicted are replaced); labels: doc_id, toxic. Adds held_out, score (0 to 1), restored and
    predicted (1 if score >= threshold). Ids, sources and languages are no inputs of a score.
    Null text counts as empty and gets the prior; null doc_id is never held out; repeated rows get
    equal scores; empty labels leave every score at the prior.
    """
    trigrams = count_trigrams(docs)
    lexicon = fit_lexicon(docs, labels, labelled_rows=labelled_rows)
    scored = score_texts(docs.drop("held_out", "predicted"), lexicon, trigrams)
    return scored.withColumns({"held_out": held_out(F.col("doc_id").cast("long")), "predicted": (F.col("score") >= threshold).cast("int")})
