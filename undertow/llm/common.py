"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.runtime import discard, materialize, shared_dir

__all__ = ["WORD", "SpanHasher", "discard", "held", "lower_ascii", "materialize", "mix", "n_words", "row_slices", "shared_dir", "split_at", "text_buffer", "trimmed", "word_spans"]

#: The word pattern of every operator: runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python task holds as arrays at once (a longer text is handled alone).
SLICE_BYTES = 1 << 19

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once for each row.

    The optimizer copies a projected expression into the array functions that use it, where it
    would run again for every element; it does not look through a generator of one element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- vectorised text kernels (numpy inside Arrow tasks) ---------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


#: One random-looking 64-bit value for each byte.
BYTE_CODE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers; those of usual lengths are kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 8 * SLICE_BYTES:
            _POWERS[base] = known
    return known[:n]


class SpanHasher:
    """64-bit hashes of any byte spans of one buffer, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[data] * powers(_BASE, n), out=self.prefix[1:])
        self.inverse = powers(_BASE_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        span = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(span + (end - start).astype(np.uint64) * _GOLD)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_EDGE = np.zeros(256, dtype=bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}"]] = True


def split_at(start: np.ndarray, end: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut the spans that run over the end of their text."""
    if len(start) and len(cuts):
        k = np.searchsorted(start, cuts, side="left") - 1
        over = (k >= 0) & (end[np.maximum(k, 0)] > cuts)
        cuts = np.unique(cuts[over])
        start, end = np.sort(np.concatenate((start, cuts))), np.sort(np.concatenate((end, cuts)))
    return start, end


def trimmed(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without up to three punctuation marks at either side; some may become empty."""
    for _ in range(3):
        start = start + ((end > start) & _EDGE[low[np.minimum(start, len(low) - 1)]])
        end = end - ((end > start) & _EDGE[low[np.maximum(end - 1, 0)]])
    return start, end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary array; nulls count as empty."""
    kind = column.type
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    width = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows of about limit bytes each; no row is split."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end
