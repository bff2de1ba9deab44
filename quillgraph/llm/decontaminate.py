"""Benchmark decontamination: SimHash of item-sized windows, multi-index lookup, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.session import narrow_batches
from quillgraph.llm.text import WordHasher, map_batches, mix, text_slices

WIDTH, SIMILARITY = 5, 0.75
#: Fingerprint bits and blocks of 16 bits. Fingerprints that differ in NEAR bits of some block at most are
#: candidates: all within RADIUS are, and of random ones one in forty (137 of 65 536 values, 12 times).
BITS, BLOCKS, NEAR = 192, 12, 2
RADIUS = (NEAR + 1) * BLOCKS - 1
#: Items sent with one pass over the documents; more items take more passes.
ITEM_BLOCK = 20_000
#: Windows fingerprinted at a time, and words of a text that they may span; bounds a worker's memory.
WINDOWS, SPAN = 1024, 4096
SEED = 3

_PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()], np.uint8)
_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[_PUNCTUATION] = 32
#: Both sides of a look-up flip one bit of a block at most, so that together they reach two.
_FLIPS = np.array([0, *(1 << np.arange(16))], np.uint32)


def _words(hasher: WordHasher, data: np.ndarray, bounds: np.ndarray):
    """Hashes of words without case and punctuation, and their number by text."""
    words, counts, _ = hasher.words(_BLANKED[data], bounds)
    return words, counts


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for every fingerprint bit of every shingle."""
    words = np.stack([mix(shingles ^ np.uint64(0x5A5A5A5A * (k + 1))) for k in range(BITS // 64)], 1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)
    return bits.astype(np.float64) * 2 - 1


def _keys(prints: np.ndarray) -> np.ndarray:
    """Look-up keys (block, value with one bit flipped at most) of fingerprints, one row each."""
    values = prints.view(np.uint16).reshape(len(prints), BLOCKS).astype(np.uint32)
    keys = (values[:, :, None] ^ _FLIPS) | (np.arange(BLOCKS, dtype=np.uint32) << np.uint32(16))[None, :, None]
    return keys.reshape(len(prints), -1)


class MultiIndex:
    """Fingerprints by block: finds those that differ in NEAR bits of some block at most."""

    def __init__(self, items: list[int], prints: np.ndarray):
        keys = _keys(prints)
        owner = np.repeat(np.asarray(items, np.int32), keys.shape[1])
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.owner = keys.ravel()[order], owner[order]
        #: Whether some fingerprint has a key; indexes that are asked in turn may share it.
        self.some = np.zeros(BLOCKS << 16, bool)
        self.some[self.keys] = True

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of every candidate, each once."""
        keys = _keys(prints)
        row, col = np.nonzero(self.some[keys])
        wanted = keys[row, col]
        begin, end = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
        size = end - begin
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        both = np.unique(np.repeat(row, size).astype(np.int64) << 32 | self.owner[at])
        return both >> 32, both & 0xFFFFFFFF


class ItemIndex:
    """Items grouped by length, each length with its own multi-index over SimHash fingerprints.

    ``n`` and ``common`` (shingles of two items or more, and their numbers of items) are
    those of the whole benchmark; without them the given items are the whole benchmark.
    """

    def __init__(self, ids: list[int], texts: list[str], seed: int = SEED, n: int | None = None, common: tuple[np.ndarray, np.ndarray] | None = None):
        self.hasher = WordHasher(seed)
        self.ids, shingles, self.sizes = [], [], []
        for i, text in zip(ids, texts, strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words, _ = _words(self.hasher, raw, np.array([0, len(raw)]))
            if i is not None and len(words):
                self.ids.append(i)
                self.sizes.append(len(words))
                shingles.append(self.hasher.runs(words, min(WIDTH, len(words))))
        n = max(1, len(self.ids) if n is None else n)
        #: Distinct shingles of every item, sorted, and how often it has them.
        self.sets = [np.unique(x, return_counts=True) for x in shingles]
        keys, df = np.unique(np.concatenate([np.empty(0, np.uint64), *[x for x, _ in self.sets]]), return_counts=True)
        if common is not None:
            many = dict(zip(common[0].tolist(), common[1].tolist(), strict=True))
            df = np.array([many.get(k, 1) for k in keys.tolist()], np.int64)
        #: A shingle of many items says less; one of no item weighs like one of a single item.
        self.keys, self.key_weights = keys, 1 + np.log(n / df)
        self.unknown = 1 + np.log(n)
        self.totals = [float((self.weights(x) * c).sum()) for x, c in self.sets]
        self.known = {}
        for width in {min(WIDTH, m) for m in self.sizes}:
            own = np.unique(np.concatenate([x for (x, _), m in zip(self.sets, self.sizes, strict=True) if min(WIDTH, m) == width]))
            maybe = np.zeros(1 << 20, bool)
            maybe[own & np.uint64((1 << 20) - 1)] = True
            self.known[width] = (own, self.weights(own), maybe)
        by_size: dict[int, list[int]] = {}
        for j, m in enumerate(self.sizes):
            by_size.setdefault(m, []).append(j)
        self.by_size = {m: MultiIndex(js, np.stack([self.fingerprint(shingles[j]) for j in js])) for m, js in sorted(by_size.items())}
        some = np.zeros(BLOCKS << 16, bool)
        for index in self.by_size.values():
            some |= index.some
            index.some = some
        #: Lengths, and the weight of the lightest item of each.
        self.lengths = np.array(list(self.by_size), np.int64)
        self.least = np.array([min(self.totals[j] for j in by_size[m]) for m in self.by_size])

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(shingles), self.unknown)
        at = np.searchsorted(self.keys, shingles)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == shingles, self.key_weights[at], self.unknown)

    def fingerprint(self, shingles: np.ndarray) -> np.ndarray:
        return np.packbits((_signs(shingles) * self.weights(shingles)[:, None]).sum(0) > 0)

    def hits(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of the runs of words that are shingles of some item."""
        runs = self.hasher.runs(words, width)
        keys, weights, maybe = self.known[width]
        some = np.flatnonzero(maybe[runs & np.uint64((1 << 20) - 1)])
        at = np.searchsorted(keys, runs[some])
        at[at == len(keys)] = 0
        yes = keys[at] == runs[some]
        return some[yes], weights[at[yes]]

    def similarity(self, window: np.ndarray, j: int) -> float:
        """Weighted Jaccard of two shingle multisets."""
        a, n = np.unique(window, return_counts=True)
        b, m = self.sets[j]
        w = self.weights(a)
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = b[at] == a
        low = float((w[both] * np.minimum(n[both], m[at[both]])).sum())
        return low / (float((w * n).sum()) + self.totals[j] - low)

    def search(self, words: np.ndarray, places: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[float, int]]:
        """Items found in one text: item -> (similarity, first word); ``places`` are its hits by width.

        A text of fewer words than the item is one window, whole.
        A window none of whose shingles is an item's, or whose known shingles weigh under 0.75 of the
        lightest item of its length, has a similarity under 0.75 with all of them and gets no
        fingerprint. All other windows of every item length are looked up.
        """
        found: dict[int, tuple[float, int]] = {}
        for width, (at, weights) in places.items():
            total = np.concatenate([[0.0], np.cumsum(weights)])
            for k in np.flatnonzero((np.minimum(self.lengths, WIDTH) == width) & (self.least * SIMILARITY <= total[-1] + 1e-9)):
                m, index = int(self.lengths[k]), self.by_size[int(self.lengths[k])]
                size = min(m, len(words))
                count = size - width + 1
                if count < 1:
                    continue
                # Windows that cover a hit are stretches of starts; weight of the known shingles in each.
                first, last = np.maximum(at - count + 1, 0), np.minimum(at, len(words) - size)
                first[1:] = np.maximum(first[1:], last[:-1] + 1)
                many = np.maximum(last - first + 1, 0)
                starts = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                held = total[np.searchsorted(at, starts + count)] - total[np.searchsorted(at, starts)]
                fit = held >= SIMILARITY * self.least[k] - 1e-9
                starts, held = starts[fit], held[fit]
                for begin, end in _stretches(starts):
                    self._look_up(index, words, starts[begin:end], held[begin:end], count, width, found)
        return found

    def _look_up(self, index: MultiIndex, words, starts, held, count: int, width: int, found: dict[int, tuple[float, int]]) -> None:
        """Fingerprint the windows, verify the index's candidates, likeliest windows first."""
        low = int(starts[0])
        runs = self.hasher.runs(words[low : int(starts[-1]) + count + width - 1], width)
        rising = np.zeros((len(runs) + 1, BITS))
        np.cumsum(_signs(runs) * self.weights(runs)[:, None], axis=0, out=rising[1:])
        own = starts - low
        row, item = index.candidates(np.packbits(rising[own + count] - rising[own] > 0, axis=1))
        for i in np.argsort(-held[row], kind="stable").tolist():
            j, r = int(item[i]), int(row[i])
            # What a window shares with an item weighs no more than its known shingles.
            if min(1.0, held[r] / self.totals[j]) + 1e-9 < max(SIMILARITY, found.get(j, (0.0,))[0]) or found.get(j, (0.0,))[0] >= 1 - 1e-12:
                continue
            sim = self.similarity(runs[own[r] : own[r] + count], j)
            if sim >= SIMILARITY - 1e-12 and sim > found.get(j, (0.0,))[0]:
                found[j] = (sim, int(starts[r]))

    def scan(self, column: pa.Array):
        """(row, item index, similarity, first word, words of the window) of every match in a column of texts."""
        for row, data, bounds in text_slices(column):
            words, counts = _words(self.hasher, data, bounds)
            ends = np.cumsum(counts)
            places: dict[int, dict[int, tuple]] = {}
            for width in self.known:
                at, weights = self.hits(words, width)
                text = np.searchsorted(ends, at, "right")
                inside = at + width <= ends[text] if len(at) else np.empty(0, bool)
                at, weights, text = at[inside], weights[inside], text[inside]
                cuts = np.flatnonzero(np.diff(text)) + 1
                for a, w, t in zip(np.split(at, cuts), np.split(weights, cuts), np.split(text, cuts), strict=True):
                    if len(t):
                        places.setdefault(int(t[0]), {})[width] = (a - (ends[t[0]] - counts[t[0]]), w)
            for t, mine in places.items():
                begin = int(ends[t] - counts[t])
                for j, (sim, start) in sorted(self.search(words[begin : int(ends[t])], mine).items()):
                    yield row + t, j, sim, start, min(self.sizes[j], int(counts[t]))


def _stretches(starts: np.ndarray):
    """(begin, end) of stretches of neighbouring starts, WINDOWS and SPAN words at most each."""
    begin = 0
    while begin < len(starts):
        end = min(begin + WINDOWS, int(np.searchsorted(starts, starts[begin] + SPAN)))
        yield begin, end
        begin = end


def item_frequencies(items: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """Number of items with words, and the shingles of two items or more with their numbers of items."""

    def make():
        hasher = WordHasher(SEED)

        def each(batch: pa.RecordBatch):
            for _, data, bounds in text_slices(batch.column(0)):
                words, counts = _words(hasher, data, bounds)
                ends = np.cumsum(counts)
                own = [np.unique(hasher.runs(words[e - c : e], min(WIDTH, c))) for e, c in zip(ends.tolist(), counts.tolist(), strict=True) if c]
                if own:
                    first = np.zeros(sum(map(len, own)), np.int64)
                    first[np.cumsum([0, *map(len, own[:-1])])] = 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(first)], names=["s", "first"])

        return each

    shingles = map_batches(items, ["text"], make, "s long, first long")
    n = shingles.agg(F.coalesce(F.sum("first"), F.lit(0))).first()[0]
    common = shingles.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").toArrow()
    return n, (common.column("s").to_numpy().view(np.uint64), common.column("c").to_numpy())


def item_indexes(benchmark: DataFrame, block: int = ITEM_BLOCK):
    """Indexes of all items, at most about ``block`` items each; the benchmark is the stated query set.

    Weights are those of the whole benchmark in every index, however many there are.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    parts = max(1, -(-items.count() // max(1, block * 3 // 4)))
    n, common = item_frequencies(items) if parts > 1 else (None, None)
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toArrow().sort_by("item_id")
        yield ItemIndex(mine.column("item_id").to_pylist(), mine.column("text").to_pylist(), n=n, common=common)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of each item in each document.

    Words are compared without case and punctuation, as 5-word shingles (an item of fewer words is
    one shingle) in windows of the item's length, a shorter document as one window; a pair is given if their weighted Jaccard is 0.75
    or more. Null and empty texts and items match nothing; repeated rows match alike; an empty
    benchmark gives no rows. Fingerprints that agree in 14 of 16 bits of some block are compared
    exactly: all that differ in 35 of 192 bits at most, and of those that a similarity of 0.75 leads to
    (33 bits on average) all but one in two thousand.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, item_id long, similarity double, start_word long, n_words long"
    out = None
    for index in item_indexes(benchmark):
        if not index.ids:
            continue

        def make(index=index):
            def each(batch: pa.RecordBatch):
                rows = list(index.scan(batch.column(1)))
                if rows:
                    r, j, sim, start, size = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(r)), pa.array([index.ids[k] for k in j], pa.int64()), pa.array(sim), pa.array(start, pa.int64()), pa.array(size, pa.int64())],
                        names=[id_col, "item_id", "similarity", "start_word", "n_words"],
                    )

            return each

        part = map_batches(docs, [id_col, "text"], make, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay."""
    where = docs.columns.index("text")
    narrow_batches(docs.sparkSession)
    for index in item_indexes(benchmark):
        if not index.ids:
            continue

        def run(batches, index=index):
            for batch in batches:
                bad = {r for r, *_ in index.scan(batch.column(where))}
                yield batch.filter(pa.array([r not in bad for r in range(batch.num_rows)], pa.bool_())) if bad else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in the texts of all ``documents``."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
