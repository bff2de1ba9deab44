"""Vectorised text primitives over Arrow buffers.

Arrow hands a worker the UTF-8 bytes of a whole batch as one buffer, so words and shingles are
found and hashed with numpy over that buffer; no Python string is made for a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.session import narrow_batches

#: Bytes of text handled at a time in a worker; a longer single text is handled alone, whole.
SLICE_BYTES = 1 << 18

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words and of runs of words, by a keyed polynomial over bytes."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = rng.integers(1, 2**63, size=260, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.base, self.step = draw[256], draw[257]
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.values = mix(draw[:256].copy())
        self.lowered = self.values[_LOWER]
        for v in (self.values, self.lowered):
            v[_IS_SPACE] = 0
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self._powers) < n:
            n = max(n, SLICE_BYTES)
            for name, by in (("_powers", self.base), ("_inverses", self.inverse)):
                p = np.full(n, by, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def words(self, data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes of the texts ``data[bounds[i]:bounds[i+1]]``, words per text, and word starts."""
        n = len(data)
        if not n:
            return np.empty(0, np.uint64), np.zeros(len(bounds) - 1, np.int64), np.empty(0, np.int64)
        self._reach(n)
        space = _IS_SPACE[data]
        first = np.empty(n, bool)
        first[0] = True
        first[1:] = space[:-1]
        inner = bounds[:-1]
        first[inner[inner < n]] = True
        starts = np.flatnonzero(first & ~space)
        if not len(starts):
            return np.empty(0, np.uint64), np.zeros(len(bounds) - 1, np.int64), starts
        value = (self.lowered if lower else self.values)[data]
        value *= self._powers[:n]
        hashes = np.add.reduceat(value, starts)
        hashes *= self._inverses[starts]
        at = np.searchsorted(starts, bounds)
        return mix(hashes), np.diff(at), starts

    def runs(self, words: np.ndarray, width: int) -> np.ndarray:
        """Hash of each run of ``width`` words (over the whole array, text borders included)."""
        n = len(words) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = words[:n].copy()
        for k in range(1, width):
            out *= self.step
            out += words[k : n + k]
        return mix(out ^ np.uint64(width))


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of stretches of about SLICE_BYTES; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def map_batches(df: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` over the named columns only; ``make()`` builds the function once a task."""
    narrow_batches(df.sparkSession)

    def run(batches):
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.select(*columns).mapInArrow(run, schema)


def least_row(df: DataFrame, columns: list[str]) -> Column:
    """Aggregate: the named columns of the group's least row, as a struct; columns without an order decide nothing."""
    ordered = [c for c, t in df.dtypes if c in columns and "map<" not in t and "variant" not in t]
    return F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.struct(*[F.col(f"`{c}`") for c in ordered]))
