"""Packing in blocks against the plain sequential rule."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import packing as P
from quillgraph.operators.context import pack_batches


def plain(rows, budget, header, batch_rows):
    out, state = {}, {}
    for g, i, c in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        batch, used, n = state.get(g, (0, header, 0))
        if n and (used + (c or 0) > budget or batch_rows is not None and n >= batch_rows):
            batch, used, n = batch + 1, header, 0
        state[g] = (batch, used + (c or 0), n + 1)
        out[g, i] = batch
    return out


@pytest.mark.parametrize("budget,header,batch_rows,block", [(20, 0, None, 8), (20, 3, 4, 8), (200, 0, None, 8), (10**9, 0, None, 16), (10**9, 0, 5, 8), (0, 0, None, 7), (35, 40, None, 8), (15, 0, 30, 5)])
def test_blocks_give_the_sequential_batches(spark, budget, header, batch_rows, block):
    rng = random.Random(budget + block)
    rows = [(g, i, rng.choice([0, 0, 1, 2, 5, 9, 30, None])) for g, n in (("a", 150), ("b", 7), (None, 40), ("c", 1)) for i in range(n)]
    rows += [("z", i, 0 if i < 40 else 6) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, c int").withColumn("c", F.col("c").cast("long"))
    got = P.pack_in_blocks(df, ["g"], ["i"], "c", budget, header, batch_rows, block)
    assert got.columns == ["g", "i", "c", "batch"]
    assert {(r.g, r.i): r.batch for r in got.collect()} == plain(rows, budget, header, batch_rows)


def test_without_keys_and_empty(spark):
    rows = [("", i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, c int")
    assert {("", r.i): r.batch for r in P.pack_in_blocks(df, [], [F.col("i")], "c", 25, block_rows=16).collect()} == plain(rows, 25, 0, None)
    assert P.pack_in_blocks(df.limit(0), [], ["i"], "c", 25).collect() == []
    assert {("", r.i): r.batch for r in pack_batches(df, [], "i", "c", 25).collect()} == plain(rows, 25, 0, None)


def test_one_group_of_many_rows(spark):
    """Above BLOCK_ROWS rows the blocks are used; the batches are those of the rule."""
    n = 3 * P.BLOCK_ROWS + 17
    df = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 13).alias("c"))
    got = pack_batches(df, [], "i", "c", 100).groupBy("batch").agg(F.sum("c").alias("s"), F.count("*").alias("n"), F.min("i").alias("a"), F.max("i").alias("b")).orderBy("batch").collect()
    at = 0
    for k, r in enumerate(got):
        assert r.batch == k and r.a == at and r.b == at + r.n - 1 and r.s <= 100 and (r.b == n - 1 or r.s + (r.b + 1) % 13 > 100)
        at = r.b + 1
    assert at == n
