"""Operators 8 to 10, the pipeline, and the driver contract."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from undertow.llm import minhash_dedup, mixing, queries, token_rollup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rollup(spark, tmp_path):
    rows = [("a", "en", "one two  three"), ("a", "en", "one"), (None, "fr", "x"), ("b", None, None), ("b", None, "")]
    docs = spark.createDataFrame(rows, "source string, lang string, text string")
    words = token_rollup.count_tokens(docs, "words")
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    rollup.commit("one", inserts=words)
    rollup.commit("one", inserts=words)  # replayed
    total = lambda: Counter({(r["source"], r["lang"], r["n_docs"], r["n_tokens"]): 1 for r in rollup.totals().collect()})
    assert total() == Counter({("a", "en", 2, 4): 1, (None, "fr", 1, 1): 1, ("b", None, 2, 0): 1})
    rollup.commit("two", deletes=words.filter("source is null"), revised=(words.filter("source = 'a'"), words.filter("source = 'a'").withColumn("n_tokens", F.col("n_tokens") * 10)))
    rollup.commit("empty")
    before = total()
    broken = words.withColumn("n_tokens", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        rollup.commit("one", inserts=broken)
    assert total() == before
    assert total() == Counter({("a", "en", 2, 40): 1, ("b", None, 2, 0): 1})
    with pytest.raises(ValueError):
        rollup.commit("a/b")


def test_token_counts_match_the_tokenizer(spark):
    texts = ["Hello world, éà 123!!", None, "", "a" * 5000, "line\n\n  two"]
    docs = spark.createDataFrame([("s", "l", t) for t in texts], "source string, lang string, text string")
    encode = token_rollup._encoding(f"{token_rollup.TOKENIZERS}/byte_bpe_50k.tiktoken")
    got = sorted(r["n_tokens"] for r in token_rollup.count_tokens(docs).collect())
    assert got == sorted(len(encode.encode_ordinary(t or "")) for t in texts)
    assert encode.decode(encode.encode_ordinary(texts[0])) == texts[0]


def filled(sizes, weights, budget, repeat):
    """Shares by weight, again and again over what is not full yet."""
    target, open_ones = dict.fromkeys(sizes, 0.0), set(sizes)
    while True:
        left = budget - sum(repeat * sizes[s] for s in sizes if s not in open_ones)
        share = {s: left * weights[s] / sum(weights[o] for o in open_ones) for s in open_ones}
        over = {s for s in open_ones if share[s] > repeat * sizes[s]}
        if not over:
            return {s: share[s] if s in open_ones else float(repeat * sizes[s]) for s in target}
        open_ones -= over


def test_mix(spark):
    r = random.Random(6)
    rows = [(k, " ".join("w" for _ in range(r.randint(0, 60))), r.choice(["big"] * 6 + ["a", "b", "é", None])) for k in range(900)]
    rows += [(5000, None, "a"), (5001, "", "tiny"), (None, "x y", "b"), (7, "q q", "a"), (7, "q q", "a")]
    docs = spark.createDataFrame([(d, t, s, 3) for d, t, s in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    targets = filled(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and math.isclose(x["target"], targets[x["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= x["taken"] <= 2 * x["size"] and x["taken"] == x["copies"] * x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - targets[s]) <= 60 for s in sizes)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def glob_matches(glob, text):
    out = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.split(r"(\*\*|\*|\?)", glob))
    return re.fullmatch(out, text, re.S) is not None


def test_automaton(spark):
    import numpy as np

    r = random.Random(2)
    globs = ["".join(r.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(r.randint(1, 9))) for _ in range(60)]
    texts = ["".join(r.choice("ab/.") for _ in range(r.randint(0, 12))) for _ in range(150)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    hit = url_filter.GlobAutomaton(globs).match(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
    assert all(hit[i, k] == glob_matches(g, t) for i, t in enumerate(texts) for k, g in enumerate(globs))


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x?y#z", "https://example.com/en/", "https://a.example.com/fr/1", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/", "http://com/", "http://com", "http://notexample.com/en/a", "ftp://b.org/x://y.net/es/", None, "no scheme", "", "http://", "http://shop.cheap-pills.example.org/a/b", "http://x.org/a.exe", "http://é.NET/es/" + "p" * 30_000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = url_filter.filter_urls(pages).orderBy("page_id").collect()
    assert [r["rule"] for r in got] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", "net/fr/", None, "com/", None, "com/", None, None, None, None, None, None, None, "net/es/"]
    assert [r["verdict"] for r in got] == ["allow", "block", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "block", "block", "block"]
    assert (got[0]["host"], got[0]["path"]) == ("www.example.com", "/en/x") and got[9]["host"] == "b.org"


def test_porn_directly_under_the_host(spark):
    urls = ["http://x.org/porn/1.html", "http://x.org/a/porn/1.html", "http://x.org/a/b/porn/", "http://x.org/porn", "http://porn/a/", "http://x.org/pornography/1"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.filter_urls(frame).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["block"] * 3 + ["allow"] * 3
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    assert con.sql(f"select verdict from ({queries.SQL['op10_url_filter']}) order by page_id").fetchall() == [(r["verdict"],) for r in got]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A small corpus with planted cases."""
    r = random.Random(12)
    syllables = ["an", "er", "th", "on", "de", "la", "ion", "que", "st", "in"]
    text = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))
    items = [(k, text(30)) for k in range(5)]
    rows = [(k, text(80), "en", f"s{k % 3}") for k in range(120)]
    rows = [(k, t + (" idiot moron" if k % 6 == 0 else ""), g, s) for k, t, g, s in rows]
    rows += [(200 + k, rows[3][1] + f" tail{k}", "en", "s0") for k in range(8)] + [(300 + k, text(40) + " " + items[k][1] + " " + text(40), "fr", None) for k in range(5)]
    rows += [(400, "write to me@mail.example.com " + text(60), "en", "s1"), (401, None, None, "s1"), (None, text(60), "en", "s2")]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "http://x.net/es/1", "<p>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder), rows, items


def test_pipeline_by_stages(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {d for d, t, *_ in rows if t and "idiot" in t}
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    kept = stage["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, *_ in rows if d not in toxic)
    near = stage["near_duplicates"](spark, kept, folder)
    assert {r["doc_id"] for r in near.collect()} == {d for d, *_ in rows if d not in toxic and d not in range(200, 208)}
    clean = stage["decontamination"](spark, near, folder)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, *_ in rows if d not in toxic and d not in range(200, 208) and d not in range(300, 305)}
    safe = {r["doc_id"]: r for r in stage["personal_data"](spark, clean, folder).collect()}
    assert safe[400]["text"].startswith("write to [email] ") and safe[400]["n_chars"] == len(safe[400]["text"]) and safe[1]["text"] == rows[1][1]
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.collect()} == set(safe) and "taken" in out.columns


def test_every_query_runs(spark, tables):
    folder, *_ = tables
    for name, query in queries.QUERIES.items():
        assert query(spark, folder).count() >= 0, name


def test_sql_agrees(spark, tables):
    folder, *_ = tables
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, folder)
        columns = sorted(df.columns)
        expected = con.sql(sql).project(", ".join(columns)).fetchall()
        assert Counter(map(tuple, df.select(columns).collect())) == Counter(expected), name
