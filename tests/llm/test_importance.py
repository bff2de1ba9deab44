"""Importance resampling against features spelled out and zlib's CRC."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def spelled(text, most):
    words = WORD.findall(lower(text))
    return [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, most=1, buckets=10000, least=20, per_cent=10):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in spelled(t, most))
    s, t = count(d[1] for d in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, text in docs:
        f = spelled(text, most)
        w = sum(gain(zlib.crc32(x.encode()) % buckets) for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(WORD.findall(lower(text)))])
    some = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(some[: per_cent * len(some) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_crc_of_words_and_runs():
    algebra = im.CrcAlgebra()
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in [1, 2, 3, 31, 32, 33, 64, 1000, *rng.integers(1, 40, 60)]]
    ends = np.cumsum([len(w) for w in words])
    got = algebra.words(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    assert got.tolist() == [zlib.crc32(w) for w in words]
    sizes = np.array([len(w) for w in words])
    assert algebra.joined(got[:-1], got[1:], sizes[1:]).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]
    zero = np.array([123456789], np.uint32)
    assert algebra.shift(zero, np.zeros(1, np.int64))[0] == 123456789


def test_features_of_a_slice_stay_in_their_texts():
    texts = ["One two THREE", "", "é漢 x1", "four", "!!", "five six " + "long" * 30]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    owner, crcs, words = im.features(im.CrcAlgebra(), data, bounds, 3)
    want = sorted((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in spelled(t, 3))
    assert sorted(zip(owner.tolist(), crcs.tolist())) == want and words.tolist() == [len(WORD.findall(lower(t))) for t in texts]


@pytest.mark.parametrize("most,buckets", [(1, 10000), (3, 64)])
def test_rows_equal_plain_ones(spark, most, buckets):
    rng = np.random.default_rng(most)
    docs = [(i, " ".join(f"W{rng.integers(0, 60)}" for _ in range(rng.integers(0, 60)))) for i in range(150)]
    docs += [(None, "no id but many words " * 9), (200, None), (201, ""), (202, "?!"), (203, "é" * 5000 + " long " * 3000)]
    target = ["W1 w2 W3 w4", None, "", "w1 w2"]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("id", F.lit(0))
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = im.importance_resample(d, t, most_words=most, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target, most, buckets)


def test_repeated_rows_and_empty_tables(spark):
    row = (1, "some words " * 15)
    d, none = spark.createDataFrame([row] * 10 + [(2, "other words " * 15)] * 10, "doc_id long, text string"), spark.createDataFrame([], "text string")
    got = im.importance_resample(d, none, per_cent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 11)) and len({r.score for r in got}) == 2
    assert im.importance_resample(d.limit(0), none).collect() == []


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    got = sorted((tuple(r) for r in im.op11_importance_resample(spark, sf).collect()), key=str)
    assert got == sorted(con.execute(im.OP11_SQL).fetchall(), key=str)
