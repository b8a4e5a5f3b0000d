"""Spans of crowded texts, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from undertow.llm import pii


def test_spans_in_others_go(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        span = lambda names: (rng.choice(names), s := rng.randint(0, 60 if k else 4000), s + rng.randint(1, 12))
        base = [span(["email", "ip"]) for _ in range(rng.randint(0, 9))]
        added = [(("key", "number")[(s + e) % 2], s, e) for _, s, e in (span(["x"]) for _ in range(rng.randint(0, 30) if k else 900))]
        rows.append((k, base, added))
    spans = "array<struct<kind:string,start:int,end:int>>"
    df = spark.createDataFrame(rows, f"k int, base {spans}, added {spans}")
    got = {r["k"]: [tuple(x) for x in r["a"]] for r in df.select("k", pii._outermost(F.col("added"), F.col("base")).alias("a")).collect()}
    inside = lambda x, y: y[1] <= x[1] and x[2] <= y[2]
    for k, base, added in rows:
        kept = {x for x in added if not any(inside(x, y) for y in base) and not any(inside(x, y) and x[1:] != y[1:] for y in added)}
        assert got[k] == sorted(kept)


def test_numbers_inside_runs(spark):
    rng = random.Random(8)
    runs = ["+1" * 9, "(12) 345-6789", "+(0) 1.2.3.4.5.6.7", "7" * 200, "1" * 61 + " 22 " + "3" * 70]
    runs += [rng.choice(["", "+", "("]) + "1" + "".join(rng.choice(["", " ", ". ", "(", ")-", "-"]) + rng.choice("0123456789") * rng.choice([1, 1, 2, 5]) for _ in range(rng.choice([6, 60, 300]))) for _ in range(40)]
    df = spark.createDataFrame([(i, "call me: ", x) for i, x in enumerate(runs)], "i int, b string, x string")
    run = F.struct(F.col("x").alias("text"), F.lit(9).alias("start"), F.col("b").alias("before"))
    got = {r["i"]: [[(s["text"], s["start"], s["end"], s["before"]) for s in at] for at in r["n"]] for r in df.select("i", pii._numbers(run).alias("n")).collect()}
    for i, x in enumerate(runs):
        want = []
        for s in [0, *[m.start() for m in re.finditer(r"(?<=[^0-9])(?=[0-9])", x)]]:
            s -= s > 0 and x[s - 1] in "(+"
            ends = [s + k for k in range(7, 61) if s + k <= len(x) and x[s + k - 1].isdigit() and not x[s + k : s + k + 1].isdigit() and 7 <= sum(c.isdigit() for c in x[s : s + k]) <= 19]
            want.append([(x[s:e], 9 + s, 9 + e, ("call me: " + x[:s])[-24:]) for e in ends])
        assert got[i] == want, x
