"""N-gram join, repair of conversations, divergence of sources: against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import defaultdict
from functools import lru_cache

import pytest

from undertow.llm import jaccard_join as J
from undertow.llm import queries
from undertow.llm.conversations import damaged, repair_conversations
from undertow.llm.divergence import source_divergence

WORDS = r"[^\x20\x09-\x0D]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined_by_hand(rows, size, percent):
    """{doc_id: (n, class, links, component)}; doc ids are distinct."""
    sets = {}
    for doc, text in rows:
        w = re.findall(WORDS, (text or "").translate(LOW))
        sets[doc] = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    classes = defaultdict(list)
    for doc, s in sets.items():
        classes[s].append(doc)
    lead = {s: min(d) for s, d in classes.items() if s}
    near = {s: [t for t in lead if t is not s and t != s and 100 * len(s & t) >= percent * len(s | t)] for s in lead}
    component = {}
    for s in sorted(lead, key=lead.get):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = lead[s]
                todo += near[x]
    return {d: (len(s), lead[s], len(near[s]), component[s]) if s else (0, d, 0, d) for d, s in sets.items()}


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(n)]
    out = []
    for _ in range(edits):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(n)] = rng.choice(words)
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = [t for n, k in ((30, 40), (60, 25), (200, 12), (9, 30), (5, 20), (400, 3)) for t in family(rng, words, n, k)]
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(k)) for k in range(3, 40)]  # common passages
    texts += [" ".join(rng.choice(words[:4]) for _ in range(k % 7)) for k in range(60)]  # few words, many ties
    texts += [texts[0].upper(), "  " + texts[0].replace(" ", "\t\n"), None, "", " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("size", "percent", "small"), [(4, 85, False), (4, 85, True), (3, 60, True), (2, 100, True)])
def test_join_equals_brute_force(spark, corpus, monkeypatch, size, percent, small):
    if small:  # short lists, several bands and blocks
        for name, value in (("_SHORT", 2), ("_BLOCK_GRAMS", 500), ("_BLOCK_CLASSES", 6)):
            monkeypatch.setattr(J, name, value)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in J.jaccard_join(docs, size=size, percent=percent).select("doc_id", "n_shingles", "class_id", "n_links", "component_id").collect()}
    assert got == joined_by_hand(corpus, size, percent)


def test_join_by_shuffle_instead_of_broadcast(spark, corpus, monkeypatch):
    monkeypatch.setattr(J, "_BROADCAST_KEYS", 0)
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_join(docs, size=4, percent=85).collect()}
    assert got == {d: w[3] for d, w in joined_by_hand(corpus, 4, 85).items()}


def test_join_edge_cases(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(1, "a b c d e", "u"), (1, "a b c d e", "u"), (None, "A B C D E", "v"), (2, long, None), (3, long + " y", None), (None, None, None), (None, "only here now", None), (4, "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tid string")
    got = sorted(map(tuple, J.jaccard_join(docs.withColumnRenamed("tid", "cls"), size=4, percent=85).collect()), key=repr)
    n = 30_000 - 3
    assert got == sorted([(1, 2, 1, 0, 1)] * 2 + [(None, 2, 1, 0, 1), (2, n, 2, 1, 2), (3, n + 1, 3, 1, 2), (None, 0, None, 0, None), (None, 1, None, 0, None), (4, 1, 4, 0, 4)], key=repr)
    assert J.jaccard_join(docs.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        J.jaccard_join(docs, percent=0)


def test_sizes_lose_nothing():
    for percent in (50, 80, 85, 99, 100):
        sizes = J.Sizes(percent)
        for n in range(1, 400):
            assert 1 <= sizes.prefix(n) <= sizes.drawn(n) <= n
            assert sizes.shared(n + 1) >= sizes.shared(n)
            assert 100 * sizes.partner(n) >= percent * n > 100 * (sizes.partner(n) - 1)


# --- conversations -------------------------------------------------------------------------------


def repaired_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        to = after[state]
        if inserted < 3:
            cost, audit, out = best(i, to, inserted + 1)
            ways.append((cost + 3, "I" + audit, ((name[to], ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit, out))
            if faults[i] not in ("b", "d"):
                more = 3 if faults[i] == "t" else 0
                if role[:1] == to or (state == "" and role[:1] == "s"):
                    cost, audit, out = best(i + 1, role[:1], 0)
                    ways.append((cost + more, "K" + audit, ((role, text), *out)))
                cost, audit, out = best(i + 1, to, 0)
                ways.append((cost + more + 3, "R" + audit, ((name[to], text), *out)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)


def random_conversations(rng, n, longest):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""])
            text = rng.choice(["", " ", "Yes.", "No", "Why?", f"text {turn}!", f"cut {turn}", "é ü.  \n"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("batch", [8192, 5])
def test_repair_equals_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr("undertow.llm.conversations._BATCH_ROWS", batch)
    rows = random_conversations(random.Random(3), 150, 14)
    want = defaultdict(list)
    for conv, *row in rows:
        want[conv].append(tuple(row))
    # The batch size is a number of this module; local workers are forked after it was changed.
    from undertow.llm.conversations import _RESULT, _ROW, _repair, faults
    import pyarrow as pa

    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sorted_rows = faults(frame.selectExpr("conv_id", "false dropped", "turn", "role", "text")).orderBy("conv_id", "turn", "role", "text", "duplicate").select(*_ROW).toArrow()
    costs = {"keep": 0, "rerole": 3, "delete": 4, "insert": 3, "truncated": 3}
    found = pa.Table.from_batches(list(_repair(costs)(iter(sorted_rows.to_batches(max_chunksize=37)))), _RESULT)
    assert {r["conv_id"]: tuple(r.values())[1:] for r in found.to_pylist()} == {c: repaired_by_hand(r) for c, r in want.items()}
    through_spark = {r[0]: tuple(r)[1:] for r in repair_conversations(frame).collect()}
    assert through_spark == {c: repaired_by_hand(r) for c, r in want.items()}


def test_repair_edge_cases(spark):
    rows = [(None, None, None, None, 1), (None, 0, "user", "Hi.", 1), (7, 1, "user", "Hi.", 2), (7, 1, "user", "Hi.", 2), (7, 9, "assistant", "x" * 3_000_000 + ".", 2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, blank int")
    got = {r["conv_id"]: r for r in repair_conversations(frame).collect()}
    assert (got[7]["audit"], got[7]["gaps"], got[7]["duplicate"], got[7]["cost"]) == ("KDK", 7, 1, 4)
    assert got[7]["repaired_sha256"] == hashlib.sha256(f"user:Hi.\nassistant:{'x' * 3_000_000}.".encode()).hexdigest()
    assert (got[None]["audit"], got[None]["blank"], got[None]["cost"]) == ("DD", 1, 8) or got[None]["audit"] == "DKI"
    assert tuple(got[None])[1:] == repaired_by_hand([(None, " ", " "), (0, "user", "Hi.")])
    gone = frame.selectExpr("*", "true dropped")
    assert {tuple(r) for r in repair_conversations(gone).collect()} == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (None, 7)}
    assert repair_conversations(frame.limit(0)).isEmpty()


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "Well. So! What?") for c in range(40) for t in range(5)] + [(None, 3, None, None)]
    got = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{t}".encode()) % 20
        text, role = text or " ", role or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, kind == 0, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_a_long_conversation_goes_through_many_batches(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(20_000)]
    got = repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()[0]
    assert (got["audit"], got["cost"], got["illegal"]) == ("K" * 20_000, 0, 0)
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows).encode()).hexdigest()


# --- divergence ----------------------------------------------------------------------------------


def divergence_by_hand(rows, least_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(set))
    groups = defaultdict(set)
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in term.findall(text or ""):
            t = t.translate(LOW)
            counts[lang, source][t] += 1
            docs[lang][t].add(k)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if len(d) >= least_docs]
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        shares, base = {s: p(counts[lang, s]) for s in sources}, p(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            rank = lambda items: sorted(items, key=lambda x: (-x[1], x[0].encode()))
            pairs = rank([(r, sum(f(shares[s][t], shares[r][t]) for t in kept)) for r in sources if r != s])
            terms = rank([(t, f(shares[s][t], base[t])) for t in kept if counts[lang, s][t] and shares[s][t] > base[t]])[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items, 1)]
    return out


def test_divergence_equals_brute_force(spark):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ab", "Cé", "éf", "GH", "日本") for b in "qrstuvwxyz"]
    rows = [(" ".join(rng.choice(words[: 3 * (k % 17) + 1]) + rng.choice([".", "1", "", "_x"]) for _ in range(k % 23)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ç", "", None])) for k in range(160)]
    rows += [(None, "fr", "only"), ("", "it", "x"), ("unique words here", "it", "y"), ("word " * 50_000, "en", "a"), ("word", "en", "b"), ("word", "en", "b")]
    frame = spark.createDataFrame([(*r, 1.5) for r in rows], "text string, lang string, source string, value double").repartition(5)
    got = sorted(map(tuple, source_divergence(frame, least_docs=3, top_terms=7).collect()))
    assert got == sorted(divergence_by_hand(rows, 3, 7))
    assert source_divergence(frame.limit(0)).isEmpty()


def test_their_queries_are_registered():
    for name in ("op11_ngram_jaccard_join", "op12_conversation_repair", "op13_source_divergence"):
        assert name in queries.QUERIES
