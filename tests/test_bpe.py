"""Byte-pair tokens against a sequential encoder, and windows against a plain reading of their rule."""

import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from quillgraph.functions import bpe
from quillgraph.operators.relational import running_sums

RANKS = bpe.read_ranks()
SEQUENTIAL = tiktoken.Encoding("test", pat_str=bpe.WORDS, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(3)
    letters = "abcdefgh ABC'\n\t .,0123éßñ漢字かなкири🙂́‍\x00"
    out = ["", " ", "   \n\n x", "it's we'll THEY'RE", "漢字とかな交じり文", "Здравствуй, мир", "مرحبا بالعالم", "🙂🙂👩‍👩‍👧", "a" * 3000, " " * 2000, "ab" * 1500, "<|endoftext|>"]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(150)]


def test_tokens_equal_a_sequential_encoder():
    pairs = bpe.BytePairs(RANKS)
    for text in texts():
        want = SEQUENTIAL.encode_ordinary(text)
        assert pairs.encode(text) == want and pairs.count(text) == len(want) and pairs.decode(want) == text
        assert all(pairs.decode(want[a : a + 7]) == SEQUENTIAL.decode(want[a : a + 7]) for a in range(0, len(want), 5))


def test_merging_takes_the_lowest_rank_first():
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"bc": 0, b"ab": 1, b"abc": 2, b"cd": 3, b"aa": 4, b"aaa": 5}
    pairs = bpe.BytePairs(ranks, r".+")
    back = lambda w: [pairs.bytes_of[i] for i in pairs.merge(w)]
    assert back(b"abcd") == [b"abc", b"d"] and back(b"abd") == [b"ab", b"d"] and back(b"aaaaa") == [b"aa", b"aaa"] and back(b"x") == [b"x"]


def test_columns_and_missing_file(spark):
    t = bpe.BpeTokens(spark)
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts()[:40], None])], "i int, text string")
    for r in df.withColumn("n", t.num_tokens("text")).withColumn("ids", t.ids("text")).withColumn("back", t.text("ids")).collect():
        assert r.ids == SEQUENTIAL.encode_ordinary(r.text or "") and r.n == len(r.ids) and r.back == (r.text or "")
    with pytest.raises(FileNotFoundError, match="merge ranks"):
        bpe.BpeTokens(spark, "/nowhere/ranks")


@pytest.mark.parametrize("size,overlap", [(7, 3), (50, 0), (5, 4)])
def test_windows_equal_plain_ones(spark, size, overlap):
    rows = [("ab"[i % 2] if i % 7 else None, i, x) for i, x in enumerate(texts()[:60])] + [("c", 0, ""), ("c", 1, None), ("a", 500, "one text twice"), ("a", 500, "one text twice")]
    df = spark.createDataFrame(rows, "g string, i int, text string")
    want = []
    for g in ("a", "b", "c", None):
        ids, own = [], []
        for _, i, x in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            new = SEQUENTIAL.encode_ordinary(x or "")
            ids += new
            own += [str(i)] * len(new)
        for k, at in enumerate(range(0, len(ids), size - overlap)):
            part = ids[at : at + size]
            want.append((g, k, SEQUENTIAL.decode(part), len(part), list(dict.fromkeys(own[at : at + size]))))
    got = bpe.BpeTokens(spark).windows(df, ["g"], "text", "i", size, overlap)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None, "x", "x"]), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, n int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: r.s for r in running_sums(df, ["g"], ["i"], "n", "s").collect()}
        every = {r.i: r.s for r in running_sums(df, [], [F.desc("i")], "n", "s").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: sum(n for h, j, n in rows if h == g and j <= i) for g, i, _ in rows}
    assert every == {i: sum(n for _, j, n in rows if j >= i) for _, i, _ in rows}


def test_texts_are_encoded_once_and_in_small_batches(spark, monkeypatch):
    from quillgraph.functions import bpe as B
    from quillgraph.functions.session import BATCH_ROWS

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        asked = spark.sparkContext.accumulator(0)
        real = B.BytePairs.encode
        docs = spark.createDataFrame([(i, f"text number {i} " * (i % 5)) for i in range(60)], "doc_id long, text string")
        tokens = B.BpeTokens(spark)
        assert spark.conf.get(name) == str(BATCH_ROWS)

        def counted(text):
            asked.add(1)
            return real(B.BytePairs(B.read_ranks()), text)

        from pyspark.sql import functions as F

        plain = F.udf(lambda text: counted(text or ""), "array<int>")
        monkeypatch.setattr(tokens, "_ids", plain)
        got = tokens.windows(docs, [], "text", "doc_id", 20, 5).collect()
        # The filter, the sample of the ranges and their shuffle each encoded every text.
        assert asked.value == 60
        assert sum(r.n_tokens for r in got) > 0
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("most", [100, 1])
def test_texts_that_are_groups_of_their_own_are_not_written(spark, monkeypatch, most):
    written, real = [], bpe.cut
    monkeypatch.setattr(bpe, "cut", lambda df, *a, **k: written.append((df.columns, rows := real(df, *a, **k), rows.count())) or rows)
    monkeypatch.setattr(bpe, "BATCH_ROWS", 7)
    monkeypatch.setattr(bpe, "MANY_GROUPS", most)
    rows = [(i, "ab"[i % 2], i * 10 if i % 5 else None, x) for i, x in enumerate(texts()[:40])] + [(None, None, 1, "no key, but a text of its own"), (77, "a", 2, None)]
    df = spark.createDataFrame(rows, "g long, G2 string, i int, text string")

    def plain(rows):
        out = []
        for g in {r[:2] for r in rows}:
            ids, own = [], []
            for r in sorted((r for r in rows if r[:2] == g), key=lambda r: r[2] or 0):
                new = SEQUENTIAL.encode_ordinary(r[3] or "")
                ids += new
                own += [None if r[2] is None else str(r[2])] * len(new)
            out += [(*g, k, SEQUENTIAL.decode(ids[at : at + 9]), len(ids[at : at + 9]), list(dict.fromkeys(own[at : at + 9]))) for k, at in enumerate(range(0, len(ids), 7))]
        return sorted(map(str, out))

    found = bpe.BpeTokens(spark).windows(df, ["g", "G2"], "text", "i", 9, 2)
    assert found.columns == ["g", "G2", "chunk_no", "chunk", "n_tokens", "document_ids"]
    assert sorted(map(str, map(tuple, found.collect()))) == plain(rows)
    # Only the keys of groups of several texts are written, and here there is none.
    assert [(c, n) for c, _, n in written] == [(["_k0", "_k1"], 0)]

    # Two groups of two texts beside the others: only their texts are joined, unless there are too many such groups.
    more = [*rows, (None, None, 5, " and another"), (3, "b", 900, " and one more")]
    written.clear()
    found = bpe.BpeTokens(spark).windows(spark.createDataFrame(more, df.schema), ["g", "G2"], "text", "i", 9, 2)
    assert sorted(map(str, map(tuple, found.collect()))) == plain(more)
    assert written[0][2] == 2 and (written[1][2] == 4) == (most == 100)
