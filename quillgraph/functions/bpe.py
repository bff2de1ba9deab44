"""Byte-pair tokens: counts, ids, windows and texts by a table of merge ranks."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from heapq import heapify, heappop, heappush
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.session import BATCH_ROWS, cut, narrow_batches
from quillgraph.operators.relational import running_sums

#: Ranks of the vocabulary, one ``base64-bytes rank`` a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabularies cut a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens a worker remembers.
REMEMBERED = 200_000
#: Groups of several texts, up to which their keys are broadcast; beyond that all texts are joined by the shuffle.
MANY_GROUPS = 100_000


@lru_cache(maxsize=4)
def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Bytes of every token and its rank, which is its id; a vocabulary's size bounds it."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"{path}: name a file of merge ranks, one base64 token and its rank a line")
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(token): int(rank) for token, rank in (p for p in pairs if p)}


class BytePairs:
    """Encodes words by merging, again and again, the neighbours of the lowest rank, the leftmost of equal ones."""

    def __init__(self, ranks: dict[bytes, int], words: str = WORDS):
        self.ranks, self.words = ranks, regex.compile(words)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: neighbours in a linked list, their ranks in a heap."""
        n = len(word)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        pairs = [(rank, i, i + 2) for i in range(n - 1) if (rank := self.ranks.get(word[i : i + 2])) is not None]
        heapify(pairs)
        gone = bytearray(n)
        while pairs:
            _, i, stop = heappop(pairs)
            j = after[i]
            # A pair is stale if one of its halves has been merged since.
            if gone[i] or j >= n or end[j] != stop:
                continue
            gone[j], end[i], after[i] = 1, stop, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (rank := self.ranks.get(word[left : end[right]])) is not None:
                    heappush(pairs, (rank, left, end[right]))
        return [self.ranks[word[i : end[i]]] for i in range(n) if not gone[i]]

    def word(self, word: str) -> tuple[int, ...]:
        found = self._known.get(word)
        if found is None:
            raw = word.encode()
            whole = self.ranks.get(raw)
            found = (whole,) if whole is not None else tuple(self.merge(raw))
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            if len(word) < 100:
                self._known[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [t for m in self.words.finditer(text) for t in self.word(m.group())]

    def count(self, text: str) -> int:
        return sum(len(self.word(m.group())) for m in self.words.finditer(text))

    def decode(self, ids) -> str:
        """The text of tokens; bytes of a character that is cut at an end become the replacement character."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


class BpeTokens:
    """Column functions over one vocabulary, whose table is broadcast once a session."""

    def __init__(self, spark: SparkSession, vocabulary: str = VOCABULARY):
        self._table = table = spark.sparkContext.broadcast(read_ranks(vocabulary))
        narrow_batches(spark)

        def per_batch(kind: str, one, missing):
            def batches(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
                each = BytePairs(table.value)
                for column in columns:
                    yield pd.Series([missing if v is None else one(each, v) for v in column])

            return F.pandas_udf(batches, kind)

        self._ids = per_batch("array<int>", lambda p, text: np.array(p.encode(text), np.int32), np.array([], np.int32))
        self._count = per_batch("long", lambda p, text: p.count(text), 0)
        self._text = per_batch("string", lambda p, ids: p.decode(ids.tolist() if isinstance(ids, np.ndarray) else ids), None)

    def ids(self, text: Column | str) -> Column:
        """Token ids; a null text has none."""
        return self._ids(F.col(text).cast("string") if isinstance(text, str) else text)

    def num_tokens(self, text: Column | str) -> Column:
        """Number of tokens; that of a null text is 0."""
        return self._count(F.col(text).cast("string") if isinstance(text, str) else text)

    def text(self, ids: Column | str) -> Column:
        return self._text(F.col(ids) if isinstance(ids, str) else ids)

    def windows(self, df: DataFrame, keys: Sequence[str], text: str, order: str, size: int = 300, overlap: int = 100, doc_id: str | None = None) -> DataFrame:
        """Windows of ``size`` tokens every ``size - overlap`` over the joined tokens of each group's texts.

        (keys, chunk_no, chunk, n_tokens, document_ids). Texts of a group join in ``order``, then by
        ``doc_id`` and text. Each text is cut on its own at the place that running sums of token counts
        give it, and only the at most ``size`` tokens of a window meet in one row, so no row or task
        holds a group. A group without tokens has no window. A text that is a group of its own is cut
        where it is read, and nothing of it is written or shuffled; other groups are told by their keys.
        """
        if size - overlap <= 0 or size <= 0:
            raise ValueError("size must be positive and exceed the overlap")
        doc_id = doc_id or order
        if not keys:
            return self._joined_windows(df, keys, text, order, size, overlap, doc_id)
        many = df.groupBy(*keys).agg(F.count("*").alias("_many")).where("_many > 1")
        names = [f"_k{i}" for i in range(len(keys))]
        many = cut(many.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]))
        found = many.count()
        if not found:
            return self._own_windows(df, keys, text, size, overlap, doc_id)
        if found > MANY_GROUPS:
            return self._joined_windows(df, keys, text, order, size, overlap, doc_id)
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
        alone, others = (df.join(F.broadcast(many), same, how) for how in ("left_anti", "left_semi"))
        return self._own_windows(alone, keys, text, size, overlap, doc_id).unionByName(self._joined_windows(others, keys, text, order, size, overlap, doc_id))

    def _own_windows(self, df: DataFrame, keys: Sequence[str], text: str, size: int, overlap: int, doc_id: str) -> DataFrame:
        """Windows of texts that are groups of their own."""
        step, table, wide = size - overlap, self._table, len(keys)
        rows = df.select(*keys, F.col(doc_id).cast("string").alias("_d"), F.col(text).cast("string").alias("_x"))
        kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).schema]

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = BytePairs(table.value)

            def give(batch, of, no, chunk, n):
                of = pa.array(of, pa.int64())
                own = batch.column(wide).take(of)
                documents = pa.ListArray.from_arrays(pa.array(range(len(of) + 1), pa.int32()), own)
                columns = [*(batch.column(i).take(of) for i in range(wide)), pa.array(no, pa.int64()), pa.array(chunk, pa.string()), pa.array(n, pa.int64()), documents]
                return pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(wide)), "chunk_no", "chunk", "n_tokens", "document_ids"])

            for batch in batches:
                of, no, chunk, n = [], [], [], []
                for i, x in enumerate(batch.column(wide + 1)):
                    ids = each.encode(x.as_py() or "")
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + size]
                        of.append(i)
                        no.append(k)
                        chunk.append(each.decode(part))
                        n.append(len(part))
                        if len(of) == BATCH_ROWS:
                            yield give(batch, of, no, chunk, n)
                            of, no, chunk, n = [], [], [], []
                if of:
                    yield give(batch, of, no, chunk, n)

        schema = ", ".join([*kinds, "chunk_no long, chunk string, n_tokens long, document_ids array<string>"])
        return rows.mapInArrow(windows, schema).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "chunk_no", "chunk", "n_tokens", "document_ids")

    def _joined_windows(self, df: DataFrame, keys: Sequence[str], text: str, order: str, size: int, overlap: int, doc_id: str) -> DataFrame:
        """Windows of groups of any number of texts."""
        step = size - overlap
        one = df.select(*keys, F.col(order).alias("_o"), F.col(doc_id).cast("string").alias("_d"), F.col(text).cast("string").alias("_x")).withColumn("_ids", self.ids("_x"))
        # Written once: the filter, the sample of the ranges and the ranges themselves would each encode every text.
        one = cut(one).withColumn("_n", F.size("_ids").cast("long")).where("_n > 0")
        placed = running_sums(one, keys, ["_o", "_d", "_x"], "_n", "_end").drop("_x").withColumn("_at", F.col("_end") - F.col("_n"))
        # Window k holds the tokens [k * step, k * step + size) of its group.
        first = F.greatest(F.floor((F.col("_at") - size) / step) + 1, F.lit(0)).cast("long")
        last = F.floor((F.col("_end") - 1) / step).cast("long")
        parts = placed.withColumn("chunk_no", F.explode(F.sequence(first, last)))
        begin = F.greatest(F.col("chunk_no") * step - F.col("_at"), F.lit(0)).cast("int")
        stop = F.least(F.col("chunk_no") * step + size - F.col("_at"), F.col("_n")).cast("int")
        parts = parts.select(*keys, "chunk_no", F.struct(F.col("_at").alias("at"), F.col("_d").alias("d"), F.slice("_ids", begin + 1, stop - begin).alias("ids")).alias("p"))
        whole = parts.groupBy(*keys, "chunk_no").agg(F.array_sort(F.collect_list("p")).alias("p"))
        whole = whole.select(*keys, "chunk_no", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.array_distinct(F.transform("p", lambda x: x["d"])).alias("document_ids"))
        return whole.select(*keys, "chunk_no", self.text("ids").alias("chunk"), F.size("ids").cast("long").alias("n_tokens"), "document_ids")
