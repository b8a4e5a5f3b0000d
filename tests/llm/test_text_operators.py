"""Operators 3 to 7 against brute force, planted cases and edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from undertow.llm import decontaminate, licenses, pii, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = ["an", "er", "th", "on", "de", "la", "ion", "que", "st", "in", "ung", "ado"]


def made_text(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_leaks(spark):
    r = random.Random(5)
    items = [(k, made_text(r, 20 + k)) for k in range(12)] + [(90, None), (91, "")]
    rows, expected = [], set()
    for k, (item, text) in enumerate(items[:12]):
        words = text.split()
        for j in r.sample(range(len(words)), 3):
            words[j] = "changed"
        rows += [(k, f"{made_text(r, 90)} {text.upper()}, {made_text(r, 90)}"), (100 + k, f"{made_text(r, 50)} {' '.join(words)} {made_text(r, 200)}"), (200 + k, made_text(r, 150)), (300 + k, " ".join(text.split()[:8]) + " " + made_text(r, 60))]
        expected |= {(k, item), (100 + k, item)}
    rows += [(900, None), (901, ""), (None, "short")]
    docs = spark.createDataFrame([(d, t, "m") for d, t in rows], "doc_id long, text string, matches string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found.count() == len(rows)
    got = {(x["doc_id"], x["item_id"]) for x in found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id").collect()}
    assert got == expected
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).filter("size(matches) > 0").count() == 0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row[-1]


def test_leaks_without_rare_words_or_tails(spark):
    r = random.Random(15)
    ordinary = sorted({made_text(r, 1) for _ in range(400)})
    prose = lambda n: " ".join(r.choice(ordinary) for _ in range(n))
    items, rows = [], [(k, prose(200)) for k in range(400)]
    for k in range(24):
        words = prose(20 + k).split()
        rare = r.sample(range(len(words)), 1 + k % 3)
        for j in rare:
            words[j] = f"rare{k}q{j}"
        items.append((k, " ".join(words)))
        replaced = ["changed" if j in rare else w for j, w in enumerate(words)]
        cut = words[: -(-len(words) * 3 // 4)]
        rows += [(1000 + k, f"{prose(80)} {' '.join(replaced)} {prose(90)}"), (2000 + k, f"{prose(70)} {' '.join(cut)} {prose(60)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id").collect()}
    expected = {(d, i) for d, t in rows for i, text in items if d >= 1000 and longest_common(text.split(), t.split()) >= 0.7 * len(text.split()) and d % 1000 == i}
    assert len(expected) == 48
    assert len(got & expected) / len(expected) >= 0.95 and got <= expected, (len(got & expected), got - expected)


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(50):
        a, b = [[r.randrange(4) for _ in range(r.randint(0, 12))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate._common_subsequence(decontaminate._masks(np.array(a, int)), len(a), b) == table[-1][-1]


def test_licenses_over_lines_and_by_short_names(spark):
    header = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License\n    as published by its owner."
    permission = "Permission is hereby granted, free of\ncharge, to any person obtaining a\ncopy of this software"
    rows = [(1, "intro\n\n \n" + header + "\n\nend"), (2, "Released under GPLv3."), (3, "Apache-2.0"), (4, "a\n\n" + permission), (5, "LGPLv2.1"), (6, "Released under GPLv2."), (7, "An apache helicopter flew over the house."), (8, "\n\n\n"), (9, "x y\n" * 50_000 + "\nReleased under the MIT License.\nbye")]
    rows += [(2, "Released under GPLv3.")]
    got = licenses.scan_licenses(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, parts int")).collect()
    named = Counter((r["doc_id"], r["line"], r["n_lines"], r["family"]) for r in got if r["family"] != "unknown")
    assert named == Counter([(1, 3, 3, "GPL-3.0"), (2, 0, 1, "GPL-3.0"), (2, 0, 1, "GPL-3.0"), (3, 0, 1, "Apache-2.0"), (4, 2, 3, "MIT"), (5, 0, 1, "LGPL"), (9, 50_001, 1, "MIT")])
    assert {r["doc_id"] for r in got if r["family"] == "unknown"} <= {1, 4, 6}
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses(spark):
    rows = [(1, "Le texte.\nThis work is licensed under the GNU General Public License, version 3.\nEnd"), (2, "Released under the MIT License."), (3, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (4, "mit der apache und gnu"), (5, None), (6, ""), (7, "see the Quux Public License version 9"), (None, "Released under the MIT License.")]
    got = licenses.scan_licenses(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, line int")).collect()
    assert Counter((r["doc_id"], r["line"], r["family"]) for r in got) == Counter([(1, 1, "GPL-3.0"), (2, 0, "MIT"), (3, 0, "CC-BY-NC-4.0"), (3, 1, "Apache-2.0"), (7, 0, "unknown"), (None, 0, "MIT")])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def is_valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, d[::-1]))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_personal_data(spark):
    r = random.Random(9)
    rows = [(1, "a@b@c.d 1.2.3.4.5.6.7.8 300.1.1.1 a@b.c_d@e.f +1 (234) 567-8901. 4111 1111 1111 1111 4111-1111--11111111 é 00255.1.1.1 x@y"), (2, None), (3, ""), (None, "p\u00e9 +44 20 7946 0958")]
    rows += [(100 + k, "".join(r.choice("01234567899 .-+()@aé\n") for _ in range(400))) for k in range(60)]
    rows.append((50, "x " + "7 " * 3000 + "@" * 50))
    got = {x["doc_id"]: x for x in pii.span_digest(spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, spans string")).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        listed = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if is_valid(k, m.group())] for k, p in PATTERNS.items()}
        every = ",".join(x for k in listed for x in listed[k])
        assert [got[d][f"n_{k}"] for k in listed] == [len(v) for v in listed.values()], d
        assert got[d]["base_sha256"] == hashlib.sha256(every.encode()).hexdigest() and got[d]["spans"].startswith(every), d


def test_redaction_and_added_kinds(spark):
    text = "é call (212) 555-1234, password=abcdef123456 bob (at) mail (dot) com a@b.cd on 2020-01-02"
    docs = spark.createDataFrame([(1, text, "k", 1, 2), (2, None, "k", 1, 2), (3, "plain words 12", "k", 1, 2)], "doc_id long, text string, kind string, found int, spans int")
    rows = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert rows[1]["text"] == "é call (212) 555-1234, [secret] [contact] [email] on 2020-01-02" or "[number]" in rows[1]["text"]
    assert "[secret]" in rows[1]["text"] and "[email]" in rows[1]["text"] and "2020-01-02" in rows[1]["text"]
    assert rows[2]["text"] is None and rows[3]["text"] == "plain words 12" and rows[1]["kind"] == "k" and rows[1]["found"] + rows[1]["spans"] == 3


def test_long_and_overlapping_candidates(spark):
    long_secret, long_key = "ab12" * 120, "A1B2C3D4" * 40
    rows = [(1, f"x password={long_secret} y"), (2, "call +1 555 123 4567 555-987-6543 now"), (3, "token=secret=abcdef123456 z"), (4, f"see {'w' * 80}(at){'m' * 80} (dot) com ok"), (5, "code " + "Q" * 41 + "7" + "Z" * 20 + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got[1] == "x [secret] y" and got[3] == "x [secret] z".replace("x ", "") and got[4] == "see [contact] ok"
    assert not re.search("555|4567|6543", got[2]), got[2]
    assert re.fullmatch(pii.KEY, long_key) and re.fullmatch(pii.KEY, rows[4][1].split()[1])


def test_quality(spark):
    r = random.Random(4)
    rows = [(k, made_text(r, 80) + "\nline\n" + made_text(r, 5) + "\nline # $") for k in range(60)]
    rows += [(100 + k, "BUY!! NOW!! " * 20 + "CLICK!! " * r.randint(20, 60) + " ".join(f"X{r.randrange(999)}!!" for _ in range(80))) for k in range(30)]
    rows += [(500, None), (501, ""), (502, "a b c a b c"), (None, "a a a a a"), (503, " \x0b x\xa0y ")]
    labels = [(k, 1) for k in range(0, 60, 2)] + [(100 + k, 0) for k in range(0, 30, 2)] + [(None, 1), (7777, 0)]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_words int")
    got = {x["doc_id"]: x for x in quality.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        w, x = WORD.findall(t or ""), got[d]
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        marked = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [s for s in (t or "").split("\n") if WORD.search(s)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked))
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == expected, d
        assert x["base_failed"] == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (x["base_failed"] and x["kept"])
    assert all(got[k]["kept"] for k in range(60)) and not any(got[100 + k]["kept"] for k in range(30))


def test_toxicity(spark):
    r = random.Random(8)
    bad = ["stupid", "idiot", "moron"]
    rows = [(k, made_text(r, 60)) for k in range(300)]
    rows = [(k, t if k % 5 else t + " " + bad[k // 5 % 3] + ", " + made_text(r, 9)) for k, t in rows]
    labels = [(k, int(k % 5 == 0)) for k, _ in rows]
    hidden = ["you 1d10t", "what a M0R0N!!", "so s t u p i d really", "stuuupid", "m-o-r-o-n here", "$tup1d"]
    rows += [(1000 + i, made_text(r, 20) + " " + h + " " + made_text(r, 20)) for i, h in enumerate(hidden)]
    rows += [(2000, None), (2001, ""), (None, "ERR0R 404 a b c d"), (2002, "x" * 200_000)]
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double")
    frame = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x["doc_id"]: x for x in frame.collect()}
    assert len(got) == len(rows)
    import zlib

    assert all(x["held_out"] == (zlib.crc32(str(d if d is not None else "").encode()) % 3 == 1) for d, x in got.items())
    assert all(got[d]["predicted"] == y for d, y in labels)
    assert [got[1000 + i]["predicted"] for i in range(len(hidden))] == [1] * len(hidden)
    assert all(got[d]["predicted"] == 0 and 0 <= got[d]["score"] <= 1 for d in (2000, 2001, 2002, None))


def test_toxicity_of_long_and_split_disguises(spark):
    r = random.Random(18)
    bad = ["stupid", "idiot", "azz"]
    rows = [(k, made_text(r, 60)) for k in range(300)]
    rows = [(k, t if k % 5 else t + " " + bad[k // 5 % 3] + ", " + made_text(r, 9)) for k, t in rows]
    labels = [(k, int(k % 5 == 0)) for k, _ in rows]
    hidden = ["i" + "d" * 30 + "iot", "id-iot", "i.d.iot", "an-id1ot", "a i d i o t", " ".join("onstandelastupiderthon"), " ".join("stupididiot"), " ".join("on the la " * 4 + "idiot").replace("   ", " ")]
    rows += [(1000 + i, made_text(r, 20) + " " + h + " " + made_text(r, 20)) for i, h in enumerate(hidden)]
    rows += [(1100, made_text(r, 20) + " @22 " + made_text(r, 9))]
    clean = ["well-known on-line x.org 455 1337 $100 **** ###", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "s t u", "p i d"]
    rows += [(2000 + i, t) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[1000 + i]["predicted"] for i in range(len(hidden))] == [1] * len(hidden), [got[1000 + i]["restored"] for i in range(len(hidden))]
    assert got[1100]["predicted"] == 1
    assert [got[2000 + i]["predicted"] for i in range(len(clean))] == [0] * len(clean)


def test_decoding_is_the_cheapest_path():
    r = np.random.RandomState(0)
    decoder = toxicity.Decoder(r.randint(1, 9, 27**3), ())
    from itertools import product

    for token in ("1a0", "aab", "s1t3", "a.b"):
        options = decoder._lattice(token)

        def cost(word):
            c = [0, 0, *(ord(x) - 96 for x in word), 0]
            return sum(decoder.cost[a, b, d] for a, b, d in zip(c, c[1:], c[2:]))

        assert decoder.decode(token) == min(("".join(p) for p in product(*options)), key=cost)
