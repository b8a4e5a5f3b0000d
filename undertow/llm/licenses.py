"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs end at blank lines; a notice may be wrapped over the lines of one, and one may list several
licences line by line, so each line is classified, and each paragraph of several lines as a whole.
Features are word n-grams (one to three words) of a small vocabulary: those of the templates, and those
with an anchor word, such as "license" or "spdx". A sparse multinomial
logistic regression over the licence families, "unknown" (licence talk of no known family) and
"none" is fitted here on generated variants of the templates, with a fixed seed. A family is
reported if its probability reaches the threshold calibrated on held-out variants and a template of
it shares enough words with the paragraph; licence talk that fails either is "unknown".

DataFrame functions only. What has no anchor word names no licence, by rule: each template has one. So
a pattern over the anchor words, which a version may follow ("GPLv3"), finds all that is to be
classified, and only that leaves its text.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statements by which works name their licence (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GPLv3",
    ),
    "LGPL": ("This library is free software under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1", "LGPLv2.1", "LGPLv3"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Distributed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
_UNKNOWN = (
    "Licensed under the {w} {w} License, version {n}.",
    "Released under the {w} license.",
    "All rights reserved. Copyright {n} {w} {w}.",
    "Use of this work is subject to the license terms of {w}.",
    "This {w} is distributed under a license of {w}, see copyright notice.",
    "Released under GPLv2.",
    "Released under the GNU AGPLv3.",
    "SPDX-License-Identifier: GPL-2.0-or-later",
)
#: Further ways to name a family, for training only: too few words to compare with.
_SHORT = {
    "GPL-3.0": ("Released under GPLv3.", "Licensed under the GNU GPLv3."),
    "LGPL": ("Released under LGPLv2.1.", "Licensed under the GNU LGPLv3."),
    "Apache-2.0": ("Released under Apache 2.0.", "Apache-2.0 license"),
}
_NONE = (
    "The driver lost the license plate near {w} {w}.",
    "They were licensed to {w} and {w} by the state of {w}.",
    "An apache helicopter flew over {w} with a gnu and a {w}.",
    "He went to MIT to study {w} with permission from {w}.",
    "The {w} had permission for {w} and {w}.",
)
ANCHORS = ("license", "licensed", "licence", "licenses", "licences", "licenced", "copyright", "gpl", "lgpl", "agpl", "bsd", "mozilla", "mpl", "cc0", "commons", "spdx", "redistribution", "redistribute", "permission", "unencumbered")
_ANCHOR = r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(ANCHORS, key=len, reverse=True)) + r"|apache[ -]?(?=2))(?:v?[0-9][0-9.]*)?(?![a-z0-9])"
_TOKEN = r"[a-z0-9]+"
#: A version right behind the name is a word of its own.
_VERSION = r"(gpl)[ ,]*v?([0-9])"
#: A paragraph with the blank lines behind it.
_PARAGRAPH = r"(?s).+?(?:\n[ \t\r]*(?=\n)(?:\s*\n)?|\z)"
#: Below this probability of the best class there is too little evidence of licence talk.
_LEAST = 0.3


def _grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _words_of(text: str) -> list[str]:
    return re.findall(_TOKEN, re.sub(_VERSION, r"\1 \2", text.lower()))


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]  # n-gram to one weight for each class
    bias: tuple[float, ...]
    threshold: float


def _examples(per_class: int, seed: int) -> tuple[list[list[str]], list[str]]:
    r = random.Random(seed)
    made = lambda: "".join(r.choice(["an", "er", "th", "on", "de", "la", "ion", "que", "st", "in", "ung", "ado"]) for _ in range(r.randint(1, 4)))

    def fill(t: str) -> str:
        return re.sub(r"\{n\}", lambda _: str(r.randint(1, 2030)), re.sub(r"\{w\}", lambda _: made(), t))

    def vary(t: str) -> list[str]:
        words = [w for w in _words_of(t) if r.random() > 0.04]
        before, after = [made() for _ in range(r.choice([0, 0, 2, 6]))], [made() for _ in range(r.choice([0, 0, 3, 12]))]
        return before + words + after

    sets = {name: templates + _SHORT.get(name, ()) for name, templates in TEMPLATES.items()} | {"unknown": _UNKNOWN, "none": _NONE}
    texts, labels = [], []
    for name, templates in sets.items():
        for k in range(per_class):
            texts.append(vary(fill(templates[k % len(templates)])))
            labels.append(name)
    return texts, labels


@lru_cache(maxsize=2)
def fit(per_class: int = 120, rounds: int = 300, rate: float = 2.0, sparsity: float = 2e-4, seed: int = 11) -> Model:
    """Proximal gradient descent on the L1-penalised log-loss; the threshold is the 0.9 quantile of the probabilities of wrong families on held-out examples, at least 0.4 and at most 0.9."""
    texts, labels = _examples(per_class, seed)
    classes = (*TEMPLATES, "unknown", "none")
    own = {g for templates in TEMPLATES.values() for t in templates for g in _grams(_words_of(t))}
    seen = Counter(g for t in texts for g in set(_grams(t)) if g in own or set(ANCHORS) & set(g.split()))
    grams = sorted(g for g, n in seen.items() if n >= 5)
    index = {g: i for i, g in enumerate(grams)}

    def matrix(rows: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(grams)))
        for k, t in enumerate(rows):
            for g in set(_grams(t)) & index.keys():
                x[k, index[g]] = 1.0
        return x / np.maximum(1.0, np.sqrt(x.sum(axis=1, keepdims=True)))

    def probability(x: np.ndarray) -> np.ndarray:
        z = x @ w + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    x, y = matrix(texts), np.array([classes.index(c) for c in labels])
    target = np.eye(len(classes))[y]
    w, bias = np.zeros((len(grams), len(classes))), np.zeros(len(classes))
    for _ in range(rounds):
        error = (probability(x) - target) / len(x)
        w = w - rate * 10 * (x.T @ error)
        w = np.sign(w) * np.maximum(0.0, np.abs(w) - rate * 10 * sparsity)
        bias = bias - rate * error.sum(axis=0)
    held_texts, held_labels = _examples(per_class, seed + 1)
    p = probability(matrix(held_texts))
    best, truth = p.argmax(axis=1), np.array([classes.index(c) for c in held_labels])
    wrong = p.max(axis=1)[(best != truth) & (best < len(TEMPLATES))]
    threshold = float(np.clip(np.quantile(wrong, 0.9) if len(wrong) else 0.5, 0.4, 0.9))
    kept = {g: tuple(float(v) for v in w[i]) for g, i in index.items() if np.any(w[i] != 0)}
    return Model(classes, kept, tuple(float(b) for b in bias), threshold)


def _sql_grams(words: Column) -> Column:
    def joined(n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(words, joined(2), joined(3)))


def scan_licenses(docs: DataFrame, *, least_shared: float = 0.6) -> DataFrame:
    """One row for each line that names a licence, and for each paragraph that does so over several lines.

    docs: doc_id long, text string (other columns are ignored). Returns doc_id, line (from 0; of a
    paragraph the first), family (a key of TEMPLATES, or "unknown"), probability (of the class before
    confirmation), shared (largest share of a template's words that the line or paragraph has) and
    n_lines (1 for a line). A paragraph of several lines has a row only if a family is confirmed for
    it, of whose templates it has more words than any of its lines; these keep their own rows, and
    one of them may stand as "unknown".

    Null or empty texts and texts without licence talk give no row, nor does an empty table; repeated
    rows give theirs each; null doc_id is kept; long texts are read whole; of classes with equal
    probability the first in the order of TEMPLATES is taken.
    """
    model = fit()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter(F.col("text").rlike(_ANCHOR))
    # A paragraph keeps the blank lines behind it, so that its lines can be counted.
    blocks = found.select("doc_id", F.explode(F.array(F.regexp_extract_all("text", F.lit(_PARAGRAPH), F.lit(0)))).alias("blocks"))
    breaks = lambda b: F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit("")))
    before = F.aggregate("blocks", F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + breaks(b))))
    blocks = blocks.select("doc_id", "blocks", F.explode(F.array(before)).alias("before"))
    blocks = blocks.select("doc_id", F.explode(F.arrays_zip(F.col("blocks").alias("block"), F.slice("before", 1, F.size("blocks")).alias("at"))).alias("p")).select("doc_id", "p.*")
    blocks = blocks.filter(F.col("block").rlike(_ANCHOR)).select("doc_id", "at", F.explode(F.array(F.split("block", "\n"))).alias("lines"))
    # Blank lines behind a paragraph belong to no notice.
    blocks = blocks.select("doc_id", "at", "lines", F.explode(F.array(F.filter("lines", lambda t: F.length(F.trim(t)) > 0))).alias("full"))
    line = F.transform("lines", lambda t, i: F.struct((F.col("at") + i).alias("line"), F.lit(1).alias("n_lines"), F.array(t).alias("parts")))
    whole = F.when(F.size("full") > 1, F.array(F.struct(F.col("at").alias("line"), F.size("full").alias("n_lines"), F.col("full").alias("parts")))).otherwise(F.array().cast("array<struct<line:int,n_lines:int,parts:array<string>>>"))
    rows = blocks.select("doc_id", F.explode(F.concat(line, whole)).alias("u")).select("doc_id", "u.*")
    rows = rows.withColumn("paragraph", F.array_join("parts", " ")).filter(F.col("paragraph").rlike(_ANCHOR))
    words = lambda t: F.regexp_extract_all(F.regexp_replace(F.lower(t), _VERSION, "$1 $2"), F.lit(_TOKEN), F.lit(0))
    rows = rows.select("doc_id", "line", "n_lines", "parts", F.explode(F.array(words(F.col("paragraph")))).alias("words"))
    carried = ["doc_id", "line", "n_lines", "parts", "words"]
    rows = rows.select("*", F.explode(F.array(_sql_grams(F.col("words")))).alias("grams"))
    table = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    vectors = F.filter(F.transform("grams", lambda g: F.element_at(table, g)), lambda v: v.isNotNull())
    rows = rows.select(*carried, F.explode(F.array(vectors)).alias("vectors"))
    zero = F.array(*[F.lit(0.0) for _ in model.classes])
    total = F.aggregate("vectors", zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    scale = F.greatest(F.lit(1.0), F.sqrt(F.size("vectors").cast("double")))
    logits = F.zip_with(total, F.array(*[F.lit(b) for b in model.bias]), lambda x, b: x / scale + b)
    rows = rows.select(*carried, F.explode(F.array(logits)).alias("z"))
    top = F.array_max("z")
    norm = F.aggregate(F.transform("z", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)
    name = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("z", top).cast("int"))
    rows = rows.select(*carried, name.alias("best"), (1.0 / norm).alias("probability")).filter(f"best != 'none' and probability >= {_LEAST}")
    # Words of each line of a paragraph, by which it is seen whether one line says it all.
    rows = rows.withColumn("each", F.when(F.col("n_lines") > 1, F.transform("parts", words)).otherwise(F.array().cast("array<array<string>>")))
    shared = by_line = F.lit(0.0)
    for family, templates in TEMPLATES.items():
        for t in templates:
            own = F.array(*[F.lit(w) for w in sorted(set(_words_of(t)))])
            share = lambda w: F.size(F.array_intersect(own, w)) / F.size(own)  # noqa: E731, B023
            shared = F.greatest(shared, F.when(F.col("best") == family, share(F.col("words"))).otherwise(0.0))
            by_line = F.greatest(by_line, F.when(F.col("best") == family, F.coalesce(F.array_max(F.transform("each", share)), F.lit(0.0))).otherwise(0.0))
    rows = rows.select("doc_id", "line", "n_lines", "best", "probability", shared.alias("shared"), by_line.alias("by_line"))
    sure = (F.col("probability") >= model.threshold) & (F.col("shared") >= least_shared)
    rows = rows.filter((F.col("n_lines") == 1) | (sure & (F.col("by_line") < F.col("shared"))))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.when(sure, F.col("best")).otherwise(F.lit("unknown")).alias("family"), "probability", "shared", F.col("n_lines").cast("long").alias("n_lines"))
