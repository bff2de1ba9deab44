"""Removal of repeated strings against a plain reading of its rule."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import suffix_dedup as sd


def plain(docs, length):
    once = sorted({(i, (t or "").encode()) for i, t in docs}, key=lambda d: (d[0] is None, d[0] or 0, hashlib.sha256(d[1]).hexdigest()))
    seen, out = set(), []
    for i, text in once:
        gone = np.zeros(len(text) + 1, bool)
        for k in range(len(text) - length + 1):
            if text[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(text[k : k + length])
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((i, len(text), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), kept))
    return sorted(out, key=str)


def found(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("at", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("id", F.lit(2))
    return sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in sd.remove_repeats(df, **kw).collect()), key=str)


@pytest.mark.parametrize("length,gram,many", [(8, 3, 4096), (12, 4, 2), (9, 9, 4096), (20, 5, 1)])
def test_small_alphabets(spark, length, gram, many):
    rng = np.random.default_rng(length)
    docs = [(int(i), "".join(rng.choice(list("ab" if i % 3 else "abcdé"), rng.integers(0, 90)))) for i in rng.permutation(60)]
    docs += [(100, "a" * 200), (101, "a" * 200), (None, docs[0][1]), (None, None), (102, None), (103, ""), (104, docs[1][1][:length]), (5, "another text of id five " * 3), (5, "another text of id five " * 3)]
    assert found(spark, docs, length=length, gram=gram, many=many) == plain(docs, length)


def test_passages_copies_and_edits(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 5000, n))
    base, passage = text(400), text(40)
    docs = [(i, text(30) + passage + text(20)) for i in range(40)] + [(100 + i, base) for i in range(20)]
    docs += [(200 + i, base[: 200 * i] + "X" + base[200 * i + 1 :]) for i in range(8)] + [(300, passage[:99]), (301, passage[:100]), (302, passage * 3), (303, "é" * 400)]
    got = found(spark, docs)
    assert got == plain(docs, 100) and sum(r[2] for r in got) > 10000
    assert found(spark, docs, many=3) == got


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    grams = sd.Grams(20, 5)
    rng = np.random.default_rng(9)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    strings = lambda size: sorted((o + f + k, o + s) for o, part, b in sd.pieces(data, np.array([0, len(data)]), 20, size) for s, f, n, *_ in zip(*grams.samples(part, b)) for k in range(n))
    assert strings(10**6) == strings(64) and [a for a, _ in strings(64)] == list(range(2981))


def test_equal_strings_have_their_sample_at_one_place():
    grams = sd.Grams(20, 5)
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    sample, first, count, key, _ = grams.samples(data, np.array([0, 1500, 1510, 4000]))
    by_text = {}
    for s, f, n, k in zip(sample, first, count, key):
        for i in range(f, f + n):
            assert f <= s and s + 5 <= i + 20 and i <= s
            by_text.setdefault(data[i : i + 20].tobytes(), set()).add((int(s - i), int(k)))
    assert all(len(v) == 1 for v in by_text.values()) and sum(count) == 1481 + 2471


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 0, 0, b"")]


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got = sorted(tuple(r) for r in sd.op12_suffix_dedup(spark, sf).collect())
    assert got == sorted(con.execute(sd.OP12_SQL).fetchall()) and sum(r[2] for r in got) > 1000
