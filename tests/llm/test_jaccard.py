"""The shingle join against all pairs."""

import random

import numpy as np
import pytest

from quillgraph.llm import jaccard as J


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n=160):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choice(words) for _ in range(40))
    base = [" ".join(r.choice(words) for _ in range(r.choice([3, 5, 9, 20, 60, 150]))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        text = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            text[r.randrange(len(text))] = r.choice(words)
        text = " ".join(text)
        if r.random() < 0.3:
            text = passage + " " + text
        rows.append((i, text.upper() if r.random() < 0.1 else text))
    return rows + [(900, ""), (901, None), (902, " \n\t"), (903, "one two"), (904, "One  two"), (905, "x " * 3000), (906, "x " * 50), (907, "été Été")]


@pytest.mark.parametrize("tile,hot", [(256, 131_072), (4, 50)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, tile, hot):
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "HOT_TOKENS", hot)
    rows = corpus(tile)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, c int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()}
    assert got == plain(rows)


def test_a_large_group_of_near_copies_costs_no_pairs_of_tiles(spark, monkeypatch):
    """Tiles of one component are not compared, and what lies between components is."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(600)]
    base = [r.choice(words) for _ in range(200)]
    rows = []
    for i in range(60):  # near copies of one text; each differs in its own place
        text = base[:]
        text[3 * i] = f"x{i}"
        rows.append((i, " ".join(text)))
    half = base[:130] + [f"y{k}" for k in range(70)]
    rows += [(100 + i, " ".join([*half[:-1], f"z{i}"])) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(J, "TILE", 5)
    monkeypatch.setattr(J, "HOT_TOKENS", 8)
    seen, dealt = [], J._dealt
    monkeypatch.setattr(J, "_dealt", lambda rows, find: seen.append(rows.count()) or dealt(rows, find))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()} == plain(rows)
    assert max(seen) < 10 * len(rows)


def test_texts_are_joined_where_ids_are_too_many(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_DOCS", 0)
    rows = corpus(9, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()} == plain(rows)


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (2, "q z")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in J.jaccard_components(docs).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 2)]


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_trees_rule_out_no_link(seed):
    rng = np.random.default_rng(seed)
    base = [np.sort(rng.choice(10**6, int(rng.choice([4, 30, 200, 900])), replace=False)).astype(np.uint64) for _ in range(6)]
    sets = []
    for _ in range(90):
        s = base[rng.integers(6)]
        keep = rng.random(len(s)) > rng.choice([0, 0.05, 0.15, 0.3])
        extra = rng.choice(10**6, int(len(s) * rng.choice([0, 0.05, 0.2])), replace=False).astype(np.uint64)
        sets.append(np.unique(np.concatenate([s[keep], extra])) if keep.any() else s)
    sizes = np.array([len(s) for s in sets])
    left = {(min(p, q), max(p, q)) for ps, qs in J.candidate_pairs(J.Signatures(sizes, [J.bitmap(s) for s in sets])) for p, q in zip(ps.tolist(), qs.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 75 * (sizes[i] + sizes[j] - inter):
                assert (j, i) in left


def test_links_through_rows_without_an_id(spark):
    """A text between two others links them, whether its row has an id or not."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(words[k : k + 50]) for k in (0, 5, 10))
    for middle in (None, 3):
        docs = spark.createDataFrame([(1, a), (middle, b), (2, c), (middle, b)], "doc_id long, text string")
        got = J.jaccard_components(docs).collect()
        assert {r.component_id for r in got} == {1} and len(got) == 4
    docs = spark.createDataFrame([(None, a), (None, b), (None, c), (7, "apart " * 9)], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in J.jaccard_components(docs).collect()) == ["7", "None", "None", "None"]


@pytest.mark.parametrize("seed", range(4))
def test_sets_meet_at_the_first_shingle_they_share_only_if_it_reaches_both(seed):
    rng = np.random.default_rng(seed)
    fresh = lambda n: np.sort(rng.choice(2**58, n, replace=False).astype(np.uint64) << np.uint64(5))
    for n in (1, 2, 3, 7, 40, 300):
        s = fresh(n)
        lost, more = int(rng.integers(0, n // 7 + 1)), int(rng.integers(0, n // 7 + 1))
        t = np.union1d(rng.choice(s, n - lost, replace=False), fresh(more))
        inter = len(np.intersect1d(s, t))
        if 100 * inter < 75 * (len(s) + len(t) - inter) or len(s) == len(t) == inter:
            continue
        rows = [(k, J.class_key(keys)[0]) for keys in (s, t) for k in J.prefix(keys).tolist()]
        token, c = (np.array(x, np.int64) for x in zip(*[r for r in rows if r[0] >= 0], strict=True))
        found = {x for b in J._blocks(token, c) for x in b.column(2).to_pylist()}
        assert found == set(c.tolist())
    # One shingle in common, at the ends of both prefixes: no link can begin there.
    s, t = fresh(400), fresh(400)
    at = J.prefix_length(400) - 1
    t[at] = s[at]
    s, t = np.sort(s), np.sort(t)
    rows = [(k, J.class_key(keys)[0]) for keys in (s, t) for k in J.prefix(keys).tolist()]
    token, c = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    assert not list(J._blocks(token, c))


def test_small_tables_do_not_take_a_task_for_every_shuffle_partition(spark, monkeypatch):
    from quillgraph.operators import components

    seen, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: seen.append((done := cut(df)).rdd.getNumPartitions()) or done)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    kept = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("24", "false"), strict=True):
            spark.conf.set(n, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "src long, dst long")
        found = {r.node: r.component for r in components.connected_components(edges).collect()}
    finally:
        for n, v in zip(names, kept, strict=True):
            spark.conf.set(n, v)
    assert found == {i: 0 for i in range(41)} | {90: 90, 91: 90}
    assert max(seen) <= 2
