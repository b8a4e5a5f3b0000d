"""Personal data: exact base patterns, and gradient-boosted trees over high-recall candidates.

Base kinds are found by pattern and checked by value (parts of an address, Luhn sum, digit count).
Beside them, wide patterns propose candidates, each in a scan of its own: secrets after a keyword,
long mixed tokens, disguised addresses, runs of digits and the numbers inside them, and what the
base patterns matched but their checks refused.
Boosted trees over format and context features score each candidate; those above the threshold of
calibration are added. Overlaps between kinds are allowed; redaction joins them.

DataFrame functions only. A position is the running length of what stands between matches
(`split`) and of the matches themselves, in code points. The trees are fitted here, on generated
examples with a fixed seed, and applied as CASE expressions.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import held

# The patterns of the op5 contract. Where a run could be scanned again from each of its characters,
# a look-behind lets it start only at its first, or where the last match ended (\G); quantifiers
# that nothing can follow up are possessive. Both leave the matches as they are.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_BASE = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
_BYTE_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

SECRET = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)(?:[\x20]?[=:][\x20]?\"?[A-Za-z0-9+/_-]{6,}+)++"
CONTACT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\x20]?(?:\(at\)|\[at\])[\x20]?[A-Za-z0-9-]++(?:[\x20]?(?:\.|\(dot\)|\[dot\])[\x20]?[A-Za-z0-9-]++)++"
KEY = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{16,}+(?![A-Za-z0-9])"
#: A whole run of digits and what separates them; _numbers takes it apart.
NUMBER = r"[+(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+"
_WIDE = {"secret": SECRET, "contact": CONTACT, "key": KEY, "number": NUMBER}
#: Digits of a number inside a longer run, and characters that they may take.
_FEWEST, _MOST, _REACH = 7, 19, 60
_CONTEXT = 24
_FOUND = "_pii_found"
_SPAN = "struct<kind:string,start:int,end:int>"
_PHONE_WORDS = r"(?i)(?:tel|phone|call|mobile|fax|whatsapp|sms)[^a-zA-Z]{0,4}$"
_ID_WORDS = r"(?i)(?:ssn|passport|account|iban|card|id)[^a-zA-Z]{0,6}$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(sizes: Column, block: int = 256) -> Column:
    """Sum of the elements before each element, in blocks, so that long arrays cost no squares."""
    add = lambda a, x: a + x
    sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / block).cast("int")), lambda b: F.aggregate(F.slice(sizes, b * block + 1, F.lit(block)), F.lit(0), add))
    before = lambda s: F.aggregate(s, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return let(sums, lambda s: let(before(s), lambda p: F.transform(sizes, lambda x, i: F.get(p, F.floor(i / block).cast("int")) + F.aggregate(F.slice(sizes, F.floor(i / block).cast("int") * block + 1, i % block), F.lit(0), add))))


def _highest_before(values: Column, block: int = 256) -> Column:
    """The largest of the values before each one, in blocks; null for the first."""
    part = lambda i: F.floor(i / block).cast("int")
    tops = F.transform(F.sequence(F.lit(0), part(F.size(values))), lambda b: F.array_max(F.slice(values, b * block + 1, F.lit(block))))
    before = lambda t: F.transform(t, lambda _, b: F.array_max(F.slice(t, F.lit(1), b)))
    return let(tops, lambda t: let(before(t), lambda p: F.transform(values, lambda _, i: F.greatest(F.get(p, part(i)), F.array_max(F.slice(values, part(i) * block + 1, i % block))))))


def _outermost(added: Column, base: Column) -> Column:
    """The added spans that lie in no base span and in no longer added one, each once.

    Ends are doubled and base spans made wider by one on each side, so that an equal base span is
    wider too. By start, and the longest first, a span lies in another if one before it ends no
    earlier. Equal added spans are of the same text, thus of the same kind.
    """
    place = lambda x, wider, kind: F.struct((x["start"] * 2 - wider).alias("low"), (-x["end"] * 2 - wider).alias("back"), kind.alias("kind"))
    every = F.array_sort(F.concat(F.transform(base, lambda x: place(x, 1, F.lit(None).cast("string"))), F.transform(added, lambda x: place(x, 0, x["kind"]))))
    free = lambda a: let(_highest_before(F.transform(a, lambda x: -x["back"])), lambda high: F.filter(a, lambda x, i: x["kind"].isNotNull() & (F.coalesce(F.get(high, i), F.lit(-1)) < -x["back"])))
    whole = lambda x: F.struct(x["kind"].alias("kind"), (x["low"] / 2).cast("int").alias("start"), (-x["back"] / 2).cast("int").alias("end"))
    return F.array_sort(F.transform(let(every, free), whole))


def _found(text: Column, pattern: str, possible: Column) -> Column:
    """The matches of a pattern and the pieces around them; null where there are none."""
    return F.when(possible, F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")))


def _placed(found: Column) -> Column:
    """array<struct<text, start, end, before, after>> of what _found gives."""
    gaps = F.transform(found["m"], lambda x, i: F.length(F.get(found["p"], i)) + F.length(x))

    def place(starts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            start = F.get(starts, i) + F.length(F.get(found["p"], i))
            return F.struct(
                x.alias("text"),
                start.alias("start"),
                (start + F.length(x)).alias("end"),
                F.right(F.get(found["p"], i), F.lit(_CONTEXT)).alias("before"),
                F.left(F.get(found["p"], i + 1), F.lit(_CONTEXT)).alias("after"),
            )

        return F.transform(found["m"], one)

    return F.when(F.size(found["m"]) > 0, let(gaps, lambda g: let(_running(g), place)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    def total(d: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            v = F.substring(d, -(i + 1), F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
            return a + F.when(v > 9, v - 9).otherwise(v)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), step)

    return let(_digits(x), lambda d: F.when(F.length(d).between(13, 19), total(d) % 10 == 0).otherwise(F.lit(False)))


def _valid(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(rf"^{_BYTE_PART}(?:\.{_BYTE_PART}){{3}}$")
    if kind == "card":
        return _luhn(x)
    return F.length(_digits(x)).between(9, 15)


def _numbers(run: Column) -> Column:
    """The numbers of a run: for each group of digits, those that start there and end with one of the next groups."""
    pieces = F.split(run["text"], "(?<=[^0-9])(?=[0-9])", -1)
    # Every piece but the first and the last has two characters or more, so that a few of them hold what is asked for.
    ahead, back = _REACH // 2 + 3, _CONTEXT // 2 + 2

    def from_start(p: Column, s: Column, i: Column) -> Column:
        earlier = F.greatest(i - back, F.lit(0))
        prior = F.array_join(F.transform(F.slice(p, earlier + 1, i - earlier), lambda x: F.right(x, F.lit(_CONTEXT + 1))), "")
        window = F.array_join(F.transform(F.slice(p, i + 1, F.lit(ahead)), lambda x: F.left(x, F.lit(_REACH + 1))), "")
        return let(F.struct(s.alias("s"), prior.alias("prior"), window.alias("w")), with_lead)

    def with_lead(x: Column) -> Column:
        lead = F.when(F.right(x["prior"], F.lit(1)).isin("(", "+"), F.right(x["prior"], F.lit(1))).otherwise("")
        return let(lead, lambda c: let(F.struct((x["s"] - F.length(c)).alias("s"), F.left(x["prior"], F.length(x["prior"]) - F.length(c)).alias("prior"), F.left(F.concat(c, x["w"]), F.lit(_REACH + 1)).alias("w")), spans))

    def spans(x: Column) -> Column:
        good = F.filter(
            F.sequence(F.lit(_FEWEST), F.lit(_REACH)),
            lambda k: (k <= F.length(x["w"])) & F.substr(x["w"], k, F.lit(1)).rlike("[0-9]") & ~F.substr(x["w"], k + 1, F.lit(1)).rlike("[0-9]") & F.length(_digits(F.left(x["w"], k))).between(_FEWEST, _MOST),
        )
        before = F.right(F.concat(run["before"], x["prior"]), F.lit(_CONTEXT))
        return F.transform(good, lambda k: F.struct(F.left(x["w"], k).alias("text"), (run["start"] + x["s"]).alias("start"), (run["start"] + x["s"] + k).alias("end"), before.alias("before"), F.lit("").alias("after")))

    starts = lambda p: let(_running(F.transform(p, lambda x: F.length(x))), lambda at: F.transform(p, lambda _, i: from_start(p, F.get(at, i), i)))
    return let(pieces, starts)


# --- the trees ---------------------------------------------------------------------------------

FEATURES = ("digits", "letters", "length", "separators", "secret", "disguised", "phone_word", "id_word", "mixed", "leading_plus", "groups")


def _features(x: Column, before: Column) -> list[Column]:
    count = lambda c: F.length(F.regexp_replace(x, f"[^{c}]", ""))
    flag = lambda c: c.cast("int")
    return [
        count("0-9"),
        count("A-Za-z"),
        F.length(x),
        count(r"\x20().-"),
        flag(x.rlike("^" + SECRET)),
        flag(x.rlike(r"\((?:at|dot)\)|\[(?:at|dot)\]")),
        flag(before.rlike(_PHONE_WORDS)),
        flag(before.rlike(_ID_WORDS)),
        flag(x.rlike("[A-Z]") & x.rlike("[0-9]") & ~x.rlike("[a-z]")) + flag(x.rlike("[a-z]") & x.rlike("[0-9]")) * 2,
        flag(F.substring(x, 1, 1) == "+"),
        F.size(F.split(x, "[^0-9]+")),
    ]


def _features_of(x: str, before: str) -> list[float]:
    """The same features of one generated example."""
    count = lambda c: len(re.findall(f"[{c}]", x))
    before = before[-_CONTEXT:]
    search = lambda p, s: int(re.search(p.replace("(?i:", "(?i:"), s) is not None)
    return [
        count("0-9"),
        count("A-Za-z"),
        len(x),
        count(r"\x20().-"),
        search("^" + SECRET, x),
        search(r"\((?:at|dot)\)|\[(?:at|dot)\]", x),
        search(_PHONE_WORDS, before),
        search(_ID_WORDS, before),
        int(bool(re.search("[A-Z]", x) and re.search("[0-9]", x) and not re.search("[a-z]", x))) + 2 * int(bool(re.search("[a-z]", x) and re.search("[0-9]", x))),
        int(x[:1] == "+"),
        len(re.split("[^0-9]+", x)),
    ]


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates with their contexts: personal or secret ones, and what looks like them."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeiourstnlhd") for _ in range(r.randint(2, 9)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    upper = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))
    cue = lambda: r.choice(["tel ", "phone: ", "call ", "mobile ", "fax: "])
    positive = [
        lambda: (f'{r.choice(["password", "token", "secret", "api_key", "pwd"])}{r.choice(["=", " = ", ": "])}{r.choice(["", chr(34)])}{hexa(r.randint(8, 40))}', word() + " "),
        lambda: (f"{word()}{r.choice([' (at) ', '(at)', ' [at] '])}{word()}{r.choice([' (dot) ', '.', '[dot]'])}com", word() + " "),
        lambda: (f"AKIA{upper(16)}" if r.random() < 0.6 else upper(r.randint(18, 32)) + digits(2), word() + " "),
        lambda: (f"({digits(3)}) {digits(3)}-{digits(4)}", cue()),
        lambda: (f"{digits(3)}-{digits(3)}-{digits(4)}", cue()),
        lambda: (f"{digits(3)}-{digits(2)}-{digits(4)}", r.choice(["ssn ", "SSN: ", "id "])),
        lambda: (digits(r.randint(8, 12)), r.choice(["account ", "passport ", "IBAN "])),
    ]
    negative = [
        lambda: (digits(r.randint(7, 19)), word() + " "),
        lambda: (f"{r.randint(1900, 2099)}-{digits(2)}-{digits(2)}", word() + " "),
        lambda: (f"{digits(2)}.{digits(2)}.{r.randint(1900, 2099)}", word() + " "),
        lambda: (f"{digits(3)} {digits(3)} {digits(3)}", word() + " "),
        lambda: (".".join(str(r.randint(0, 999)) for _ in range(4)), "version "),
        lambda: ("-".join(digits(4) for _ in range(4)), word() + " "),
        lambda: (hexa(r.choice([32, 40, 64])), r.choice(["commit ", "sha ", word() + " "])),
        lambda: (word() + word() + word() + digits(1), word() + " "),
        lambda: (f"+{digits(3)}.{digits(3)}", word() + " "),
    ]
    rows, labels = [], []
    for _ in range(n):
        label = int(r.random() < 0.5)
        rows.append(_features_of(*r.choice(positive if label else negative)()))
        labels.append(label)
    return np.array(rows, dtype=float), np.array(labels)


Tree = tuple[int, float, tuple[int, float, float, float], tuple[int, float, float, float]]


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float, float, float]:
    """(feature, cut, value at or below, value above) of the split with the largest gain."""
    best = (-1.0, (0, 0.0, 0.0, 0.0))
    value = lambda m: float(g[m].sum() / (h[m].sum() + 1.0)) if m.any() else 0.0
    for f in range(x.shape[1]):
        levels = np.unique(x[:, f])
        for cut in (levels[:-1] + levels[1:]) / 2:
            low = x[:, f] <= cut
            gain = g[low].sum() ** 2 / (h[low].sum() + 1.0) + g[~low].sum() ** 2 / (h[~low].sum() + 1.0)
            if gain > best[0]:
                best = (gain, (f, float(cut), value(low), value(~low)))
    return best[1]


@lru_cache(maxsize=2)
def fit_trees(n: int = 3000, rounds: int = 24, rate: float = 0.4, seed: int = 7) -> tuple[tuple[Tree, ...], float, float]:
    """(trees of depth 2, first value, threshold on the summed value).

    The threshold is calibrated on as many held-out examples: the smallest value above which at
    most 1 in 200 of the negatives lies.
    """
    x, y = _examples(n, seed)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(n, base)
    trees: list[Tree] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        f, cut, _, _ = _best_split(x, g, h)
        low = x[:, f] <= cut
        sides = tuple(_best_split(x[m], g[m], h[m]) if m.sum() > 1 else (0, 0.0, 0.0, 0.0) for m in (low, ~low))
        tree = (f, cut, *[(s[0], s[1], rate * s[2], rate * s[3]) for s in sides])
        trees.append(tree)
        total += _apply(tree, x)
    held_x, held_y = _examples(n, seed + 1)
    value = base + sum(_apply(t, held_x) for t in trees)
    return tuple(trees), base, max(float(np.quantile(value[held_y == 0], 0.995)), 0.0)


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    f, cut, low, high = tree
    leaf = lambda s: np.where(x[:, s[0]] <= s[1], s[2], s[3])
    return np.where(x[:, f] <= cut, leaf(low), leaf(high))


def _tree_score(features: Column, trees: tuple[Tree, ...], base: float) -> Column:
    leaf = lambda s: F.when(F.get(features, s[0]) <= s[1], s[2]).otherwise(s[3])
    total = F.lit(base)
    for f, cut, low, high in trees:
        total = total + F.when(F.get(features, f) <= cut, leaf(low)).otherwise(leaf(high))
    return total


def _kind_of(x: Column) -> Column:
    kind = F.lit("number")
    for name in ("key", "contact", "secret"):
        kind = F.when(x.rlike(f"^(?:{_WIDE[name]})$"), name).otherwise(kind)
    return kind


def find_personal_data(docs: DataFrame, *, threshold: float | None = None) -> DataFrame:
    """Spans of personal data of every text.

    docs: text string and any other columns, which are kept unless they are named base or added.
    Adds base and added, arrays of struct<kind, start, end> in code
    points, end exclusive, by kind as listed (email, ip, card, phone; the candidates' kinds by
    name) and then start. Null text counts as empty. Rows and ids are kept as they are.
    """
    trees, first, calibrated = fit_trees()
    limit = calibrated if threshold is None else threshold
    text = F.coalesce(F.col("text"), F.lit(""))
    digits = text.rlike("[0-9]")
    possible = {"email": F.contains(text, F.lit("@")), "ip": digits, "card": digits, "phone": F.contains(text, F.lit("+")) & digits}
    raw = [_found(text, _BASE[k], possible[k]).alias(k) for k in KINDS]
    keyed = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    bracket = F.contains(text, F.lit("(")) | F.contains(text, F.lit("["))
    able = {"secret": keyed, "contact": bracket, "key": digits, "number": digits}
    raw += [_found(text, _WIDE[k], able[k]).alias(k) for k in _WIDE]
    rows = held(docs.drop("base", "added"), _FOUND, F.struct(*raw))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def span(kind: Column, m: Column) -> Column:
        return F.struct(kind.alias("kind"), m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end"))

    def base_spans(k: str) -> Column:
        good = F.filter(_placed(F.col(_FOUND)[k]), lambda m: _valid(k, m["text"]))
        return F.coalesce(F.transform(good, lambda m: span(F.lit(k), m)), none)

    base = [base_spans(k) for k in KINDS]

    def personal(m: Column) -> Column:
        whole = lambda k: m["text"].rlike(f"^(?:{_BASE[k]})$") & _valid(k, m["text"])
        known = whole("email") | whole("ip") | whole("card") | whole("phone")
        return ~known & let(F.array(*[f.cast("double") for f in _features(m["text"], m["before"])]), lambda f: _tree_score(f, trees, first) > F.lit(limit))

    def kept(found: Column) -> Column:
        return F.coalesce(F.transform(F.filter(found, personal), lambda m: span(_kind_of(m["text"]), m)), none)

    def longest(starts: Column) -> Column:
        """Of each start the longest span that the trees take, without those inside one of another start."""
        best = F.filter(F.transform(starts, lambda c: F.element_at(F.concat(F.array(F.lit(None).cast(_SPAN)), kept(c)), -1)), lambda x: x.isNotNull())
        return let(best, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.greatest(i - _REACH + 1, F.lit(1)), F.least(i, F.lit(_REACH))), lambda y: y["end"] >= x["end"])))

    runs = _placed(F.col(_FOUND)["number"])
    parts = F.coalesce(F.flatten(F.transform(runs, lambda m: longest(_numbers(m)))), none)
    # Whatever its own scan proposed, in any other span or over its edge; phones and addresses that the checks refused too.
    wide = F.concat(*[kept(_placed(F.col(_FOUND)[k])) for k in ("ip", "phone", "secret", "contact", "key", "number")], parts)
    rows = rows.withColumn("base", F.concat(*base))
    rows = held(rows, "added", wide)
    return rows.withColumn("added", _outermost(F.col("added"), F.col("base"))).drop(_FOUND)


def span_digest(docs: DataFrame) -> DataFrame:
    """The op5 digest of every row: doc_id, counts, base_sha256 and spans."""
    rows = find_personal_data(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def count(k: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    counts = [count(k) for k in KINDS]
    listed = F.array_join(F.transform("base", label), ",")
    return rows.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), F.array_join(F.transform(F.concat("base", "added"), label), ",").alias("spans"))


def redact(docs: DataFrame, mark: str = "[%s]") -> DataFrame:
    """Replace every span of personal data by its kind; joined overlaps take the first one's kind.

    docs: any columns with text; the same columns come back, with null texts left null.
    """
    rest = F.struct(F.lit(0).alias("_"), *[docs[c] for c in docs.columns if c != "text"])  # whatever their names
    rows = find_personal_data(docs.select(F.col("text").cast("string").alias("text"), rest.alias("rest")))
    rows = held(rows, "spans", F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        gap = F.substr(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        return F.struct(F.when(new, F.concat(a["out"], gap, F.format_string(mark, s["kind"]))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)))
    clean = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    return rows.select(*[(clean if c == "text" else F.col("rest")[c]).alias(c) for c in docs.columns])
