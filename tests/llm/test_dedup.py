"""Operators 1 and 2 against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from undertow.llm import components, minhash_dedup, suffix_dedup

L = 60


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(40), text(120)
    near = base.split()
    rows = [(1, base), (2, base), (3, base), (None, base), (4, text(10) + passage + text(30)), (5, passage[7:] + text(5)), (6, None), (7, ""), (8, "  \n"), (9, "a" * 150), (9, "a" * 150), (10, "xy" * 90 + passage + passage), (11, "one two"), (12, "one two"), (13, "ONE  two"), (14, "one")]
    for k in range(20, 60):
        copy = list(near)
        for _ in range(k % 9):
            copy[r.randrange(len(copy))] = word()
        rows.append((k, " ".join(copy)))
    return rows


def brute_repeats(rows, first):
    texts = [(d, (t or "").encode()) for d, t in rows]
    ordered = sorted(set(texts), key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1]).digest()))
    seen = Counter()
    for d, t in texts:
        for p in range(len(t) - L + 1):
            seen[t[p : p + L]] += 1
    out, met = {}, set()
    for d, t in ordered:
        mask = bytearray(len(t))
        for p in range(len(t) - L + 1):
            w = t[p : p + L]
            if (w in met) if first else seen[w] > 1:
                mask[p : p + L] = b"\1" * L
            met.add(w)
        spans = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        kept = bytes(b for b, m in zip(t, mask) if not m)
        out[d, hashlib.md5(t).hexdigest()] = (len(t), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd, block", [(1024, 16), (2, 16), (2, 3)])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeats(spark, monkeypatch, keep, crowd, block):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "_BUCKET_CONTEXTS", crowd)  # 2: nearly all anchors count as crowded
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, tid string, owner string")
    got = suffix_dedup.remove_repeats(docs, length=L, keep=keep).collect()
    assert len(got) == len(rows)
    expected = Counter()
    by_text = brute_repeats(rows, keep == "first")
    for d, t in rows:
        expected[(d, *by_text[d, hashlib.md5((t or "").encode()).hexdigest()])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == expected


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shared(a, b, most):
    n = 0
    while n < most and n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("text", [b"abcabcabdabcabd", b"a" * 30, b"abaababaabaab" * 3, bytes(range(40))])
def test_factor_arrays(text):
    import numpy as np

    length, r = 6, random.Random(4)
    data = np.frombuffer(text, np.uint8)
    words = np.frombuffer(np.array(data, dtype=np.uint32).tobytes(), np.uint32)
    starts = np.arange(len(text) - length + 1)
    place = np.array(r.sample(range(len(starts)), len(starts)))
    for symbols in (data, words):
        levels = suffix_dedup.suffix_ranks(symbols, length)
        rank = levels[-1][1]
        assert all((rank[i] < rank[j]) == (text[i : i + length] < text[j : j + length]) for i in starts for j in starts)
        previous, following = suffix_dedup.longest_factors(levels, starts, place)
        for i in starts:
            common = [(place[j] < place[i], shared(text[i:], text[j:], length)) for j in starts if j != i]
            assert previous[i] == max((n for before, n in common if before), default=0)
            assert following[i] == max((n for before, n in common if not before), default=0)


def test_nearest_smaller():
    import numpy as np

    for n in (0, 1, 2, 9, 50):
        values, steps = random.Random(n).sample(range(100), n), [random.Random(n + 1).randrange(9) for _ in range(n)]
        expected = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(n)]
        least = [min(steps[j + 1 : i + 1]) if j >= 0 else 0 for i, j in enumerate(expected)]
        got = suffix_dedup.nearest_smaller(np.array(values, dtype=np.int64), np.array(steps, dtype=np.int64))
        assert got[0].tolist() == expected and got[1].tolist() == least


def brute_passages(rows, size):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    where, texts = {}, Counter(t or "" for _, t in rows)
    windows = {}
    for t in texts:
        w = word.findall(t)
        windows[t] = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
        for x in windows[t]:
            where.setdefault(x, set()).add(t)
    out = {}
    for t, n in texts.items():
        mask = set()
        for k, x in enumerate(windows[t]):
            if len(where[x]) > 1 or n > 1:
                mask |= set(range(k, k + size))
        out[t] = len(mask)
    return out


@pytest.mark.parametrize("crowd, block", [(1024, 16), (2, 16), (2, 3)])
def test_passages(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "_BUCKET_CONTEXTS", crowd)
    rows = corpus()
    passage = rows[4][1].split()[10:40]
    rows += [(70, "\t".join(passage) + "\n"), (71, "p q r s t u v w x y z " * 4), (72, " ".join(passage[:11])), (73, " ".join(passage[3:16]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, length=L, keep="none", passage_words=12).collect()
    expected = brute_passages(rows, 12)
    assert Counter((r["doc_id"], r["n_passage_words"]) for r in got) == Counter((d, expected[t or ""]) for d, t in rows)
    assert dict((r["doc_id"], r["n_passage_words"]) for r in got)[71] == 0  # repeats itself only


def test_a_text_longer_than_a_slice(spark):
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(600))
    long_text = "".join(r.choices("ijklmnop ", k=5 << 20))
    at = (1 << 22) - 300  # over the end of the first slice
    docs = spark.createDataFrame([(1, long_text[:at] + passage + long_text[at:]), (2, passage + "q")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(docs, length=400, keep="none", passage_words=50).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[1]["spans"][0]["start"]) == (600, 1, at)
    assert (got[2]["n_removed"], got[2]["n_spans"]) == (600, 1)
    assert got[1]["n_passage_words"] >= 50



def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rows = corpus()
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    expected = Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, cls int, n int")
    got = minhash_dedup.near_duplicates(docs, size=size, percent=percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    if size == 5:
        kept = minhash_dedup.keep_one(docs, size=size, percent=percent).collect()
        with_words = {g for g in groups if sets[g]}
        assert sum(1 for r in kept if shingles(r["text"], size)) == len(with_words) and kept[0].asDict().keys() == {"doc_id", "text", "cls", "n"}


def test_near_duplicates_of_nothing(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(30, 20), (20, 25), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 13), 1), 20: 20, 25: 20, 30: 20}
