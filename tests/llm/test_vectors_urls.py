"""Ball tree and URL automaton against plain versions."""

import fnmatch
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import ball_tree as B
from quillgraph.llm import url_filter as U


def plain_top(rows, k=5):
    vec = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in vec if i % 50 == 0}:
        own = min(v for i, v in vec if i == q)
        s = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in vec if i != q and len(v) == len(own))
        out += [(q, n + 1, i, -m) for n, (m, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 3)])
def test_top_k(spark, monkeypatch, seed, block):
    monkeypatch.setattr(B, "SHARD_ROWS", 90)
    monkeypatch.setattr(B, "LEAF_ROWS", 8)
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 430)]  # ties
    rows += [(450, None), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (550, [float("nan")] * 6), (600, [float("inf")] * 6), (None, rows[0][1]), (650, []), (700, [0.5, 0.5])]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (50, rows[9][1]), (100, rows[100][1]), (750, [0.25, 0.5])]  # repeated ids
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    v = B.integer_vectors(df)
    got = sorted(tuple(r) for r in B.top_k(v, v.where(F.col("id") % 50 == 0), query_block=block, seed_rows=50).collect())
    assert got == plain_top(rows)


def test_equal_vectors_stay_in_bounded_leaves():
    tree = B.BallTree(np.arange(3000), np.ones((3000, 4)), 64)
    assert max(len(rows) for *_, rows in tree.nodes if rows is not None) <= 64
    got, scores = tree.search(np.ones((2, 4)), np.array([0, 5]), 3, np.full(2, -np.inf))
    assert got.tolist() == [[1, 2, 3], [0, 1, 2]] and (scores == 4).all()


def test_bounds_of_other_shards_are_taken_in(tmp_path):
    a, b = (B._Blocks(f"file://{tmp_path}", name) for name in "ab")
    a.leave(4, 0, np.array([1.0, 5.0]))
    kth = np.array([2.0, -np.inf])
    b.bounds(4, 0, kth)
    assert kth.tolist() == [2.0, 5.0]
    b.bounds(4, 1, kth)  # no bounds yet
    assert kth.tolist() == [2.0, 5.0]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (50, [2.0])], "vec_id long, embedding array<double>")
    v = B.integer_vectors(df)
    assert sorted(map(tuple, B.top_k(v, v).collect())) == [(0, 1, 50, 256 * 512), (0, 2, 50, 256 * 512), (50, 1, 0, 256 * 512)]
    none = B.integer_vectors(df.limit(0))
    assert B.top_k(none, none).count() == 0


def test_node_bounds_hold():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(500, 8)) * 256)
    tree = B.BallTree(np.arange(500), x, 16)
    q = np.floor(rng.normal(size=(20, 8)) * 256)
    for centre, radius, _, rows in tree.nodes:
        if rows is not None:
            assert ((q @ x[rows].T).max(1) <= q @ centre + radius * np.sqrt((q**2).sum(1)) + 1e-6).all()


@pytest.mark.parametrize("seed", range(4))
def test_automaton(seed):
    r = random.Random(seed)
    globs = ["".join(r.choice("ab*?c") for _ in range(r.randint(0, 9))) for _ in range(60)]
    texts = ["".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in range(300)] + ["", "a" * 500]
    fits = U.ShiftAnd(globs).match([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert fits[i, j] == fnmatch.fnmatchcase(t, g), (t, g)


def test_verdicts(spark):
    urls = {
        1: ("HTTP://WWW.Example.COM/en/7x?q#f", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
        2: ("https://a.com/en/8", "a.com", "/en/8", "com/en/", "block"),
        3: ("https://xcom/en/8", "xcom", "/en/8", None, "allow"),
        4: ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        5: ("http://casino-win.example.org/fr/1", "casino-win.example.org", "/fr/1", None, "block"),
        6: (None, "", "", None, "allow"),
        7: ("no scheme/en/", "", "", None, "allow"),
        8: ("x://h?a/b", "h", "", None, "allow"),
        9: ("x://com/EN/", "com", "/EN/", None, "allow"),
        10: ("x://org/es/" + "y" * 3000, "org", "/es/" + "y" * 3000, "org/es/", "block"),
    }
    df = spark.createDataFrame([(k, v[0], "z") for k, v in urls.items()], "page_id long, url string, verdict string")
    assert {r.page_id: tuple(r)[1:] for r in U.judge_urls(df).collect()} == {k: v[1:] for k, v in urls.items()}
    assert U.judge_urls(df.limit(0)).count() == 0


def test_rules_stay_within_host_and_path(spark):
    urls = {
        1: ("http://web.archive.org/web/2020/http://shop.example.com/en/1", None, "allow"),
        2: ("http://go.example.net/to/www.example.com/en/7", None, "allow"),
        3: ("http://a.com/x.com/en/1", None, "allow"),
        4: ("http://org/es/http://b.com/en/7", "org/es/", "block"),
        5: ("http://w.org/p/casino.com/en/1", None, "block"),
        6: ("http://a.com/en/b.example.com/en/7", "com/en/", "block"),
        7: ("http://foo.net/x.com/en/1", None, "allow"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in urls.items()], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in U.judge_urls(df).collect()} == {k: v[1:] for k, v in urls.items()}


def test_rules_of_the_contract(spark):
    """The words of the contract's list, spelled out here and not read from the code."""
    urls = {
        1: ("http://a.com/en/1", "com/en/", "block"),
        2: ("http://example.com/en/7", "example.com/en/7", "allow"),
        3: ("http://a.net/de/1", "net/de/", "allow"),
        4: ("http://casino.net/de/poker", "net/de/", "allow"),
        5: ("http://w.example.net/de/8", "example.net/de/8", "block"),
        6: ("http://example.net/de/7", "net/de/", "allow"),
        7: ("http://a.org/es/1", "org/es/", "block"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in urls.items()], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in U.judge_urls(df).collect()} == {k: v[1:] for k, v in urls.items()}
    listed = {("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")}
    assert set(U.HOST_RULES) == listed
    assert all(f"('{v}', '{h}', '{p}')" in U.OP9_SQL for v, h, p in listed)


def test_globs_read_past_the_border_and_rules_do_not():
    globs = ["*.com/cas?no*", "a?b", "*net*", b"*.net" + U.BORDER + b"/x*", "*?"]
    texts = [b"w.com" + U.BORDER + b"/casino", b"a" + U.BORDER + b"xb", b"a" + U.BORDER + b"b", b"n.net" + U.BORDER + b"/xy", b"n" + U.BORDER + b"/p.net/x", U.BORDER]
    got = U.ShiftAnd(globs).match(texts)
    assert got.tolist() == [
        [True, False, False, False, True],
        [False, True, False, False, True],
        [False, False, False, False, True],
        [False, False, True, True, True],
        [False, False, True, False, True],
        [False, False, False, False, False],
    ]
