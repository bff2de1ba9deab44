"""Importance resampling towards a target text: hashed n-gram features whose CRCs are composed, never spelled out."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.session import cut
from quillgraph.llm.text import map_batches, text_slices
from quillgraph.operators.relational import enumerate_rows

BUCKETS, MOST_WORDS = 10_000, 1
LEAST_WORDS, PER_CENT, SEED = 20, 10, 2024
#: Bytes of a word whose CRC comes from tables by place; the rest of a longer word is read byte by byte.
PLACES = 32
_POLYNOMIAL = 0xEDB88320

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _tables(columns: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given by its columns, as four tables by byte of the vector."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(np.arange(256) >> bit & 1, columns[8 * k + bit], 0).astype(np.uint32)
    return out


def _times(tables: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return tables[0][vectors & 255] ^ tables[1][vectors >> 8 & 255] ^ tables[2][vectors >> 16 & 255] ^ tables[3][vectors >> 24]


class CrcAlgebra:
    """CRC-32 of words, and of runs of words from the words' CRCs and lengths.

    Appending a zero byte multiplies the register by a matrix over GF(2); its powers of two, as tables,
    shift by any length, so crc(A + B) = shift(crc(A), len(B)) xor crc(B).
    """

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(_POLYNOMIAL), byte >> 1).astype(np.uint32)
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        one = _tables((unit >> 8) ^ byte[unit & 255])  # a zero byte
        self.shifts = [one]
        while len(self.shifts) < 40:
            last = self.shifts[-1]
            self.shifts.append(_tables(_times(last, _times(last, unit))))
        # What a byte adds that stands so many bytes before the end; what the all-ones start adds by length.
        self.places, start = np.empty((PLACES, 256), np.uint32), np.full(1, 0xFFFFFFFF, np.uint32)
        self.starts = np.empty(PLACES + 1, np.uint32)
        for k in range(PLACES):
            self.places[k], self.starts[k] = byte, start[0]
            byte, start = _times(one, byte), _times(one, start)
        self.starts[PLACES] = start[0]
        self.space = np.uint32(zlib.crc32(b" "))

    def shift(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRCs as so many following bytes move them."""
        out, k = crcs.copy(), 0
        while (lengths >> k).any():
            on = (lengths >> k & 1).astype(bool)
            out[on] = _times(self.shifts[k], out[on])
            k += 1
        return out

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC of every stretch ``data[starts[i]:ends[i]]``, none empty, all in order."""
        if not len(starts):
            return np.empty(0, np.uint32)
        size = ends - starts
        inside = np.repeat(ends, size)
        at = np.arange(size.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        back = inside - at - 1
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        out = np.bitwise_xor.reduceat(self.places[np.minimum(back, PLACES - 1), data[at]], first)
        out ^= self.starts[np.minimum(size, PLACES)] ^ np.uint32(0xFFFFFFFF)
        for i in np.flatnonzero(size > PLACES):
            out[i] = zlib.crc32(data[starts[i] : ends[i]])
        return out

    def joined(self, left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
        """CRC of left, a space and right."""
        left = self.shift(left, np.ones(len(left), np.int64)) ^ self.space
        return self.shift(left, right_bytes) ^ right


def features(algebra: CrcAlgebra, data: np.ndarray, bounds: np.ndarray, most_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, CRC) of every run of 1 to ``most_words`` words of every text, and words by text."""
    low = _LOWER[data]
    inside = _IN_WORD[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
    ends = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(bounds, starts, "right") - 1
    one, size = algebra.words(low, starts, stops), stops - starts
    owners, crcs, run = [text], [one], one
    for k in range(1, most_words):
        if len(run) < 2:
            break
        run = algebra.joined(run[:-1], one[k:], size[k:])
        same = text[:-k] == text[k:]
        owners.append(text[:-k][same])
        crcs.append(run[same])
    return np.concatenate(owners), np.concatenate(crcs), np.bincount(text, minlength=len(bounds) - 1)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> np.ndarray:
    """Features of all texts by bucket; a task adds up before it sends, the driver gets one number a bucket."""
    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        algebra, total = CrcAlgebra(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, bounds in text_slices(batch.column(0)):
                _, crcs, _ = features(algebra, data, bounds, most_words)
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for bucket, n in rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[bucket] = n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds, in thousandths of a nat, from smoothed shares of source and target."""
    buckets = len(source)
    all_s, all_t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))) for s, t in zip(source.astype(float), target.astype(float), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """(id, n_words, n_features, weight) of every row; the gains of all buckets go with the plan, 8 bytes each."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    buckets = len(gain)

    def make():
        algebra = CrcAlgebra()

        def each(batch: pa.RecordBatch):
            n = batch.num_rows
            words, count, weight = (np.zeros(n, np.int64) for _ in range(3))
            for row, data, bounds in text_slices(batch.column(1)):
                owner, crcs, per_text = features(algebra, data, bounds, most_words)
                end = row + len(per_text)
                words[row:end] = per_text
                count[row:end] = np.bincount(owner, minlength=len(per_text))
                np.add.at(weight, owner + row, gain[crcs % np.uint32(buckets)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (words, count, weight))], names=["id", "n_words", "n_features", "weight"])

        return each

    return map_batches(rows, rows.columns, make, f"id {dict(rows.dtypes)['id']}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    most_words: int = MOST_WORDS,
    least_words: int = LEAST_WORDS,
    per_cent: int = PER_CENT,
    seed: int = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; ``rank`` numbers the drawn ones from 1.

    The weight is the sum of the gains of a text's features; a Gumbel number from the id's hash is
    added, so that the highest scores are a draw without replacement in proportion to the weights.
    Of the rows of ``least_words`` words or more, ``per_cent`` in a hundred are drawn. Null and empty
    texts have no feature and are never drawn; with an empty target every bucket counts as met once.
    A null id is drawn as an empty one and comes last among equal scores; rows repeated in full tie
    and take following ranks. Ranks come from ranges sorted apart, so no task orders all rows.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, most_words), bucket_counts(target, target_col, buckets, most_words))
    found = weigh(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), gain, "id", "text", most_words)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    found = cut(found.withColumn("score", (F.col("weight") + noise).cast("long")))
    some = F.col("n_words") >= least_words
    drawn = per_cent * found.where(some).count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    placed = enumerate_rows(found.where(some), "place", order)
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long")
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).unionByName(found.where(~some).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards ``benchmark``, its score, and its rank if it is drawn."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return importance_resample(docs, target)


OP11_SQL = r"""
with digits as (
  select list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, b::bigint)) as crc
), tokens as (
  select 'd' as side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents
  union all
  select 'b', null, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark
), met as (
  select side, doc_id, w, count(*) as n from tokens group by all
), vocabulary as (
  select w, hex(encode(w)) as x from (select distinct w from met)
), bucket as (
  select w, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: (('0x' || substr(x, 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(c // 256, crc[(xor(c % 256, b) + 1)::int]), 4294967295::bigint), 4294967295::bigint) % 10000 as k
  from vocabulary, digits
), sizes as (
  select k, coalesce(sum(n) filter (side = 'd'), 0)::double as s, coalesce(sum(n) filter (side = 'b'), 0)::double as t from met join bucket using (w) group by k
), totals as (
  select sum(s) as ss, sum(t) as tt from sizes
), gain as (
  select k, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::bigint as g from sizes, totals
), weights as (
  select doc_id, sum(n)::bigint as n_features, sum(n * g)::bigint as weight from met join bucket using (w) join gain using (k) where side = 'd' group by doc_id
), scored as (
  select d.doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from documents d left join weights w on d.doc_id = w.doc_id
), placed as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20
)
select s.doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank from scored s left join placed using (doc_id)
"""
