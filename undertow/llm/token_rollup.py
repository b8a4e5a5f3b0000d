"""Token counts kept as additive rollups, maintained by signed deltas.

A rollup is a folder of batches. A batch is a set of signed changes (insert +, delete -, revise:
the old count - and the new one +), summed by source, language and tokenizer version before it is
stored under its own name. Each commit of a name writes a version of its own, which counts from
the moment its job has ended (Spark's `_SUCCESS` file) and then stands in place of the earlier
versions of that name: a batch that is retried, or replayed after a lost driver, counts once, and
a commit that breaks off changes nothing. One writer at a time may commit a name.

Totals are maintained: a fold stores the sums so far together with the version of each batch that
they cover, and counts from the moment its last job has ended. After it, only batches that it
does not cover are added, and where a batch has been replaced since, the version that it covers is
taken off. Commits fold by themselves when enough batches are not covered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm.common import n_words

#: The pattern that splits text before the merges of the public rank files; a fixed value of that format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
_KEYS = ("source", "lang", "tokenizer")
_TOTAL = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Files of a batch or a fold: a row for each group, of which there are few, needs no file for each shuffle partition.
_FILES = 16
_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    """The tokenizer of a rank file, loaded once in each Python worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def count_tokens(docs: DataFrame, version: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(source, lang, text) to (source, lang, tokenizer, n_tokens), one row for each input row.

    version: "words", or the name of a rank file in `folder`. Null text counts as empty: 0 tokens;
    long texts are counted whole, repeated rows each; an empty table gives no rows; other columns
    are ignored.
    """
    kept = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    if version == "words":
        return kept.select("source", "lang", F.lit(version).alias("tokenizer"), n_words(F.col("text")).alias("n_tokens"))
    path = f"{folder}/{version}.tiktoken"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["source", "lang", "tokenizer", "n_tokens"])

    return kept.mapInArrow(task, "source string, lang string, tokenizer string, n_tokens long")


@dataclass(frozen=True)
class TokenRollup:
    """Totals by source, language and tokenizer version in a folder that all executors share."""

    spark: SparkSession
    path: str
    #: Batches beyond the last fold that a commit leaves as they are.
    fold_after: int = 32

    def _batch(self, name: str) -> str:
        if not name or "/" in name or "=" in name:
            raise ValueError("a batch name is a plain file name")
        return f"{self.path}/batches/batch={name}"

    def _finished(self, pattern: str) -> list[str]:
        """The folders of a pattern whose writing job has ended."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}/_SUCCESS")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [f.getPath().getParent().toString() for f in files or ()]

    def _versions(self) -> dict[str, list[int]]:
        """The committed versions of each batch."""
        found: dict[str, list[int]] = {}
        for folder in self._finished("batches/batch=*/v=*"):
            batch, version = folder.split("/")[-2:]
            found.setdefault(batch.removeprefix("batch="), []).append(int(version.removeprefix("v=")))
        return found

    def commit(self, name: str, *, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> None:
        """Store one batch of counted rows (source, lang, tokenizer, n_tokens); revised is (before, after).

        Null keys are groups of their own; repeated rows count each; a null count is 0; other
        columns are ignored; an empty batch is a batch without rows. The same name again replaces
        the batch, it never adds to it.
        """
        signed = [(inserts, 1), (deletes, -1), *([(revised[0], -1), (revised[1], 1)] if revised else [])]
        frames = [f.select(*_KEYS, F.lit(s).cast("long").alias("n_docs"), (F.coalesce("n_tokens", F.lit(0)) * s).cast("long").alias("n_tokens")) for f, s in signed if f is not None]
        if not frames:
            frames = [self.spark.createDataFrame([], _TOTAL)]
        changes = frames[0]
        for f in frames[1:]:
            changes = changes.unionByName(f)
        sums = changes.groupBy(*_KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        # What a broken commit left in the next version's folder goes; a committed version is never touched.
        version = max(self._versions().get(name, []), default=0) + 1
        self._write(sums, f"{self._batch(name)}/v={version}")
        if len(self._uncovered()[1]) > self.fold_after:
            self.fold()

    @staticmethod
    def _write(df: DataFrame, path: str) -> None:
        df.coalesce(_FILES).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)

    def _last_fold(self) -> tuple[int, dict[str, int]]:
        """(number, {batch: version} that it covers) of the last finished fold; 0 without any."""
        numbers = [int(folder.split("/")[-2].removeprefix("f=")) for folder in self._finished("folds/f=*/covers")]
        if not numbers:
            return 0, {}
        covers = self.spark.read.schema("batch string, version int").parquet(f"{self.path}/folds/f={max(numbers)}/covers")
        return max(numbers), {r["batch"]: r["version"] for r in covers.collect()}  # a short row for each batch

    def _uncovered(self) -> tuple[int, list[str], list[str]]:
        """(number of the last fold, batches to add to it, batches to take off it), as folders."""
        number, covered = self._last_fold()
        last = {name: max(versions) for name, versions in self._versions().items()}
        folder = lambda name, version: f"{self._batch(name)}/v={version}"
        new = [folder(n, v) for n, v in last.items() if covered.get(n) != v]
        return number, new, [folder(n, v) for n, v in covered.items() if last.get(n, v) != v]

    def fold(self) -> None:
        """Store the totals of what is committed now, for later totals to start from."""
        number, new, _ = self._uncovered()
        if not new:
            return
        last = [(name, max(versions)) for name, versions in self._versions().items()]
        folder = f"{self.path}/folds/f={number + 1}"
        self._write(self.totals(), f"{folder}/totals")
        # From here on the fold counts: it is written last, and what broke off before is written again.
        self._write(self.spark.createDataFrame(last, "batch string, version int"), f"{folder}/covers")

    def totals(self) -> DataFrame:
        """Groups with a document or token left: source, lang, tokenizer, n_docs, n_tokens; no rows before any commit."""
        number, new, replaced = self._uncovered()
        read = lambda *paths: self.spark.read.schema(_TOTAL).parquet(*paths)
        stored = self.spark.createDataFrame([], _TOTAL)
        if number:
            stored = stored.unionByName(read(f"{self.path}/folds/f={number}/totals"))
        if new:
            stored = stored.unionByName(read(*new))
        if replaced:
            stored = stored.unionByName(read(*replaced).withColumns({c: -F.col(c) for c in ("n_docs", "n_tokens")}))
        sums = stored.groupBy(*_KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs != 0 or n_tokens != 0")
