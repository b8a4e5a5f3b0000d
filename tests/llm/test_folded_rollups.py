"""Totals that start from a fold, against plain sums."""

import random
from collections import Counter

from undertow.llm.token_rollup import TokenRollup

ROW = "source string, lang string, tokenizer string, n_tokens long"


def test_folds_follow_commits(spark, tmp_path):
    rng = random.Random(2)
    rollup = TokenRollup(spark, str(tmp_path / "rollup"), fold_after=3)
    batches: dict[str, list[tuple]] = {}
    for step in range(9):
        name = rng.choice("abcde")
        rows = [(rng.choice(["x", None]), rng.choice(["en", "de"]), "words", rng.randint(0, 9)) for _ in range(6)]
        batches[name] = rows
        rollup.commit(name, inserts=spark.createDataFrame(rows, ROW))
        if step == 4:
            rollup.fold()
            rollup.fold()  # nothing new: no second one
            (tmp_path / "rollup" / "folds" / "f=9" / "totals").mkdir(parents=True)  # broken off, does not count
        docs, tokens = Counter(), Counter()
        for *key, n in (r for found in batches.values() for r in found):
            docs[tuple(key)] += 1
            tokens[tuple(key)] += n
        assert {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()} == {k: (docs[k], tokens[k]) for k in docs}
    assert rollup._last_fold()[0] >= 1 and len(rollup._uncovered()[1]) <= 3


def test_a_fold_of_nothing(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "empty"))
    rollup.fold()
    assert rollup.totals().isEmpty() and rollup._last_fold() == (0, {})
    rollup.commit("a", deletes=spark.createDataFrame([(None, None, None, None)], ROW))
    rollup.fold()
    assert [tuple(r) for r in rollup.totals().collect()] == [(None, None, None, -1, 0)]
