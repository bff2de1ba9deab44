"""Removal of repeated byte strings by sorting sampled suffixes, naming them, and merging the rest.

A difference-cover sort of all suffixes samples two positions in three, which for a corpus means several
shuffles of its size times twenty. Here the cover is chosen by content: of every string of LENGTH bytes,
the GRAM-byte piece with the least hash is a sample, so two equal strings have a sample at one place
(the property that a difference cover gives), and one position in thirty-five is sampled. The steps are
those of the difference-cover sort: samples are named by their pieces; samples whose names tie are named
again by all the text around them that their strings reach; of the strings of samples that still share
the first name the suffixes between samples are merged, by sample name and distance to it, and
neighbours in that order are compared byte by byte.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.session import narrow_batches, release, remove, shared_dir
from quillgraph.llm.text import mix, text_slices

LENGTH, GRAM = 100, 32
#: Bytes of text looked at together.
PIECE = 1 << 18
#: Samples of one name and different surroundings beyond which their strings are spread by hash instead of by name.
MANY = 4096
#: Bits of a position for the place within a partition.
PLACE_BITS = 40
_LOW = np.uint64((1 << 31) - 1)


class Grams:
    """Samples of stretches of bytes, and hashes of any stretch of them."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, seed: int = 12):
        draw = np.random.default_rng(seed).integers(1, 2**63, size=(5, 256), dtype=np.int64).astype(np.uint64)
        self.length, self.gram = length, gram
        self.values = [mix(draw[k]) for k in range(3)]
        self.bases = draw[3][:3] * np.uint64(2) + np.uint64(1)
        self.salt = draw[4]
        self._powers = self._inverses = [np.ones(1, np.uint64)] * 3

    def _reach(self, n: int) -> None:
        if len(self._powers[0]) < n:
            n = max(n, PIECE + self.length)
            chain = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
            self._powers = [chain(b) for b in self.bases]
            self._inverses = [chain(np.uint64(pow(int(b), -1, 1 << 64))) for b in self.bases]

    def stretches(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hash ``which`` of every stretch ``data[begin:end]``."""
        self._reach(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[which][data] * self._powers[which][: len(data)], out=total[1:])
        return mix((total[end] - total[begin]) * self._inverses[which][begin] ^ (end - begin).astype(np.uint64))

    def samples(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(sample, first string, strings, name, name of the surroundings) of the texts ``data[bounds[i]:bounds[i+1]]``.

        Positions are those of ``data``; the strings that begin at ``first`` and the ``strings - 1``
        bytes after it have their least piece at ``sample``, the leftmost of equal ones.
        """
        n, none = len(data), np.empty(0, np.int64)
        if n < self.length:
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        h, width, base = self.values[0][data], 1, self.bases[0][None]
        grown, left, at = None, self.gram, 0
        # Pieces by doubling: the bits of the piece's width say which doubled stretches make it up.
        while left:
            if left & 1:
                part = h[at : at + n - self.gram + 1]
                grown = part.copy() if grown is None else grown * base + part
                at += width
            left >>= 1
            if left:
                h, base, width = h[:-width] * base + h[width:], base * base, 2 * width
        piece = mix(grown)
        order = (piece & ~_LOW) | np.arange(len(piece), dtype=np.uint64)
        reach, width = self.length - self.gram + 1, 1
        while 2 * width <= reach:
            order, width = np.minimum(order[:-width], order[width:]), 2 * width
        strings = n - self.length + 1
        order = np.minimum(order[:strings], order[reach - width : reach - width + strings])
        edge = np.zeros(strings + 1, np.int32)
        size = np.diff(bounds)
        long = size >= self.length
        np.add.at(edge, bounds[:-1][long], 1)
        np.add.at(edge, bounds[1:][long] - self.length + 1, -1)
        begin = np.flatnonzero(np.cumsum(edge[:-1]))
        if not len(begin):
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        sample = (order[begin] & _LOW).astype(np.int64)
        new = np.ones(len(begin), bool)
        new[1:] = (sample[1:] != sample[:-1]) | (begin[1:] != begin[:-1] + 1)
        head = np.flatnonzero(new)
        first, sample, count = begin[head], sample[head], np.diff(np.append(head, len(begin)))
        around = self.stretches(data, first, first + count - 1 + self.length, 1)
        around = mix(around ^ mix((sample - first).astype(np.uint64) + self.salt[0]))
        return sample, first, count, piece[sample], around


def pieces(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, size: int = PIECE):
    """(offset, bytes, bounds) of a slice; a text longer than ``size`` comes in stretches that overlap, so that no string is missed or met twice."""
    if len(bounds) > 2 or len(data) <= size + length:
        yield 0, data, bounds
        return
    for begin in range(0, len(data) - length + 1, size):
        part = data[begin : begin + size + length - 1]
        yield begin, part, np.array([0, len(part)])


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _grams_of(docs: DataFrame, names: bool, length: int, gram: int) -> DataFrame:
    """Samples of every text: (key) alone, or (key, name, p, pack) with p the sample's global place and pack its place in the text, distance and strings."""

    def run(batches):
        grams = Grams(length, gram)
        for batch in batches:
            at = batch.column(0).to_numpy()
            for row, data, bounds in text_slices(batch.column(1)):
                for offset, part, inner in pieces(data, bounds, length):
                    sample, first, count, key, around = grams.samples(part, inner)
                    if not names:
                        yield pa.RecordBatch.from_arrays([_signed(key)], names=["key"])
                        continue
                    text = np.searchsorted(inner, first, "right") - 1
                    place = sample - inner[text] + offset
                    pack = place << 20 | (sample - first) << 10 | count
                    yield pa.RecordBatch.from_arrays([_signed(key), _signed(around), pa.array(at[row + text] + place), pa.array(pack)], names=["key", "name", "p", "pack"])

    return docs.select("at", "text").mapInArrow(run, "key long, name long, p long, pack long" if names else "key long")


def _surroundings(rows: DataFrame, length: int) -> DataFrame:
    """(key, p, pack, around, hot) from texts and the packed samples that are asked for."""

    def run(batches):
        for batch in batches:
            at, texts, lists = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            wanted, rows_of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            pack = wanted.field("pack").to_numpy()
            first = (pack >> 20) - (pack >> 10 & 1023)
            end = first + (pack & 1023) - 1 + length
            views = [memoryview(t.as_buffer()) for t in texts]
            around = [bytes(views[i][a:b]) for i, a, b in zip(rows_of.tolist(), first.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([wanted.field("key"), pa.array(at[rows_of] + (pack >> 20)), pa.array(pack), pa.array(around, pa.binary()), batch.column(3).take(pa.array(rows_of))], names=["key", "p", "pack", "around", "hot"])

    return rows.mapInArrow(run, "key long, p long, pack long, around binary, hot boolean")


def _strings(batch: pa.RecordBatch, grams: Grams):
    """Strings of sampled surroundings: (row, distance to the sample, start in the data, data, place in the corpus)."""
    pack, p = batch.column("pack").to_numpy(), batch.column("p").to_numpy()
    around = batch.column("around")
    if isinstance(around, pa.ChunkedArray):
        around = around.combine_chunks()
    offsets = np.frombuffer(around.buffers()[1], np.int32)[around.offset : around.offset + len(around) + 1].astype(np.int64)
    data = np.frombuffer(around.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    count = pack & 1023
    row = np.repeat(np.arange(len(pack)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] - offsets[0] + step
    distance = (pack >> 10 & 1023)[row] - step
    return row, distance, start, data, p[row] - distance


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of ``length`` bytes at ``a`` and ``b`` are the same, byte by byte."""
    same = np.ones(len(a), bool)
    if length < 8:
        for k in range(length):
            same &= data[a + k] == data[b + k]
        return same
    words = np.lib.stride_tricks.as_strided(data[: len(data) - 7].view(np.uint8), (len(data) - 7, 8), (1, 1))
    wide = np.ascontiguousarray(words).view(np.uint64).ravel()
    for k in [*range(0, length - 7, 8), length - 8]:
        same &= wide[a + k] == wide[b + k]
    return same


def _repeats(batch: pa.RecordBatch, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """(row, string) of strings of surroundings whose equal stands earlier; ``string`` is its step within the row. All rows of a key must be there."""
    row, distance, start, data, place = _strings(batch, grams)
    key = batch.column("key").to_numpy().view(np.uint64)
    # Merge: strings by sample name, distance and hash; the earliest of equal ones comes first.
    word = mix(grams.stretches(data, start, start + grams.length, 2) ^ mix(key[row] ^ (distance.astype(np.uint64) << np.uint64(40))))
    by_place = np.argsort(place, kind="stable")
    order = by_place[np.argsort(word[by_place], kind="stable")]
    tie = np.flatnonzero(word[order[1:]] == word[order[:-1]])
    a, b = order[tie], order[tie + 1]
    b = b[_equal(data, start[a], start[b], grams.length)]
    b.sort()
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
    return row[b], b - first[row[b]]


def _intervals(batch: pa.RecordBatch, row: np.ndarray, step: np.ndarray, length: int) -> pa.RecordBatch:
    """(at, begin, end) of the bytes that strings cover; strings side by side in one row are one stretch."""
    pack, p = batch.column("pack").to_numpy(), batch.column("p").to_numpy()
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row))[: len(head)] - 1
    r = row[head]
    base = (pack[r] >> 20) - (pack[r] >> 10 & 1023)
    return pa.RecordBatch.from_arrays([pa.array(p[r] - (pack[r] >> 20)), pa.array(base + step[head]), pa.array(base + step[last] + length)], names=["at", "begin", "end"])


def _merged(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Intervals of repeated strings; rows lie by key, sorted, and keys are handled a few thousand strings at a time."""

    def run(batches):
        grams, held = Grams(length, gram), None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, part]) if held is not None else part
            key = held.column("key").to_numpy()
            full = int(np.searchsorted(key, key[-1], "left"))
            if full:
                yield done(held.slice(0, full), grams)
                held = held.slice(full)
        if held is not None and held.num_rows:
            yield done(held, grams)

    def done(rows: pa.Table, grams: Grams):
        batch = rows.combine_chunks().to_batches()[0]
        row, step = _repeats(batch, grams)
        return _intervals(batch, row, step, length)

    return rows.mapInArrow(run, "at long, begin long, end long")


def _by_string(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(h1, h2, place, at, begin) of every string of the rows."""

    def run(batches):
        grams = Grams(length, gram)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, _, start, data, place = _strings(batch, grams)
            pack, p = batch.column("pack").to_numpy(), batch.column("p").to_numpy()
            at = (p - (pack >> 20))[row]
            h = [grams.stretches(data, start, start + length, k) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([_signed(h[0]), _signed(h[1]), pa.array(place), pa.array(at), pa.array(place - at)], names=["h1", "h2", "place", "at", "begin"])

    return rows.mapInArrow(run, "h1 long, h2 long, place long, at long, begin long")


def _kept(rows: DataFrame, kind: str) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) from texts and the intervals that go."""

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            size, removed, spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                text = memoryview(texts[i].as_buffer())
                begin, end = np.empty(0, np.int64), np.empty(0, np.int64)
                if lists[i].is_valid:
                    wanted = lists.slice(i, 1).flatten()
                    begin, end = wanted.field("begin").to_numpy(), wanted.field("end").to_numpy()
                    order = np.argsort(begin, kind="stable")
                    begin, end = begin[order], np.maximum.accumulate(end[order])
                    new = np.ones(len(begin), bool)
                    new[1:] = begin[1:] > end[:-1]
                    begin, end = begin[new], end[np.append(np.flatnonzero(new)[1:], len(new)) - 1]
                cuts = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                size.append(len(text)), removed.append(len(text) - len(kept[-1])), spans.append(len(begin))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def _placed(docs: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """(at, id, text) of every document once, written by id; ``at`` is the place of its first byte, rising with the id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    # A row that is there twice is one document; the largest text of a hash is that text.
    if not rows.groupBy("id", "sha").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id", "sha").agg(F.max("text").alias("text"))
    order = [F.col("id").asc_nulls_last(), F.col("sha")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text", F.spark_partition_id().cast("long").alias("part"))

    def run(batches):
        place = 0
        for batch in batches:
            texts = batch.column(1)
            size = pc.binary_length(texts).to_numpy().astype(np.int64) + 1
            at = place + np.cumsum(size) - size
            place += int(size.sum())
            yield pa.RecordBatch.from_arrays([pa.array((batch.column(2).to_numpy() << PLACE_BITS) + at), batch.column(0), texts], names=["at", "id", "text"])

    sorted_.mapInArrow(run, f"at long, id {dict(rows.dtypes)['id']}, text string").write.option("compression", "zstd").parquet(f"{folder}/texts")
    return spark.read.parquet(f"{folder}/texts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every document: its bytes without those that a repeated string covers.

    A byte goes if it is covered by a string of ``length`` bytes that also starts earlier, in the same
    document or in one of a smaller id; strings are judged on the input. Null texts are empty; shorter
    texts keep all. Null ids come last; documents of one id come in the order of their SHA-256, and
    rows repeated in full are one document. ``kept`` is binary, as a cut may part a character.
    Other columns are not read. Tables between the steps lie in the shared folder and are removed,
    but for the texts, which the result is read from.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    folder = f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        release(spark)
        return spark.read.parquet(f"{folder}/{name}")

    texts = _placed(docs, id_col, text_col, folder)
    kind = dict(texts.dtypes)["id"]
    # First names. Strings of a sample whose name is met once are met once.
    named = written(_grams_of(texts, False, length, gram).groupBy("key").count().where("count > 1").select("key"), "names")
    met = written(_grams_of(texts, True, length, gram).join(named, "key", "left_semi"), "samples")
    remove(spark, f"{folder}/names")
    # Second names. Of samples that share one, the first stands for all, and the strings of the others are repeats.
    firsts = written(met.groupBy("key", "name").agg(F.min(F.struct("p", "pack")).alias("f")).select("key", "f.p", "f.pack"), "firsts")
    # Samples of one first name and several second ones: their strings are merged.
    at, begin, end = F.col("p") - F.shiftright("pack", 20), F.shiftright("pack", 20) - F.shiftright("pack", 10).bitwiseAND(F.lit(1023)), F.col("pack").bitwiseAND(F.lit(1023)) - 1 + length
    torn = firsts.groupBy("key").agg((F.count("*") > many).alias("hot"), F.count("*").alias("n")).where("n > 1").drop("n")
    lists = firsts.join(torn, "key").select(at.alias("of"), F.struct("key", "pack").alias("s"), "hot").groupBy("of", "hot").agg(F.collect_list("s").alias("s"))
    asked = lists.hint("shuffle_hash").join(texts, F.col("of") == F.col("at")).select("at", "text", "s", "hot")
    around = written(_surroundings(asked, length), "around")
    again = [_merged(around.where("not hot").repartition("key").sortWithinPartitions("key"), length, gram)]
    if not around.where("hot").isEmpty():
        strings = written(_by_string(around.where("hot"), length, gram), "strings")
        first = strings.groupBy("h1", "h2").agg(F.min("place").alias("place"))
        again.append(strings.join(first.select("place"), "place", "left_anti").select("at", "begin", (F.col("begin") + length).alias("end")))
    parts = [written(p, f"part{k}") for k, p in enumerate(again)]
    for name in ("around", "strings"):
        remove(spark, f"{folder}/{name}")
    gone = met.join(firsts.select("p"), "p", "left_anti").select(at.alias("at"), begin.alias("begin"), (begin + end).alias("end"))
    for p in parts:
        gone = gone.unionByName(p)
    gone = written(gone.groupBy("at").agg(F.collect_list(F.struct("begin", "end")).alias("gone")), "gone")
    for name in ("samples", "firsts", *(f"part{k}" for k in range(len(parts)))):
        remove(spark, f"{folder}/{name}")
    both = texts.join(gone.withColumnRenamed("at", "of").hint("shuffle_hash"), F.col("at") == F.col("of"), "left")
    return _kept(both.select("id", "text", "gone"), kind).withColumnRenamed("id", id_col)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without its repeated strings of 100 bytes."""
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
with d as (
  select doc_id, encode(coalesce(text, '')) as x from documents
), strings as (
  select doc_id, i, md5_number(x[i + 1:i + 100]) as h from (select doc_id, x, unnest(range(0, greatest(octet_length(x) - 99, 0))) as i from d)
), firsts as (
  select h, min(doc_id::hugeint * 4294967296 + i) as earliest from strings group by h
), runs as (
  select doc_id, i, i - row_number() over (partition by doc_id order by i) as g from strings join firsts using (h) where doc_id::hugeint * 4294967296 + i > earliest
), covered as (
  select doc_id, min(i) as b, max(i) + 100 as e from runs group by doc_id, g
), opened as (
  select *, coalesce(b > max(e) over (partition by doc_id order by b rows between unbounded preceding and 1 preceding), true) as fresh from covered
), spans as (
  select doc_id, min(b) as b, max(e) as e from (select *, sum(fresh::int) over (partition by doc_id order by b) as k from opened) group by doc_id, k
), gaps as (
  select s.doc_id, b, e, lag(e, 1, 0) over (partition by s.doc_id order by b) as after, x from spans s join d using (doc_id)
), kept as (
  select doc_id, string_agg(hex(x[after + 1:b]), '' order by b) || max(hex(x[tail + 1:])) as left_over, sum(e - b) as n, count(*) as k
  from (select *, max(e) over (partition by doc_id) as tail from gaps) group by doc_id
)
select d.doc_id, octet_length(x) as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(k, 0) as n_spans, case when k is null then sha256(x) else sha256(unhex(left_over)) end as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""
