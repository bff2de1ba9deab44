"""Weighted fair queueing against a plain sequential version."""

import hashlib
import re

import pytest

from quillgraph.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    """Hand out the budget by weight, cap, and hand out the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left = share * sum(sizes.values())
    free = set(order)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in list(free):
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def plain_mix(rows):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    sizes = {}
    for _, s, n in sized:
        sizes[s] = sizes.get(s, 0) + n
    target = plain_targets(sizes)
    copies, cum = [], {}
    for i, s, n in sorted(sized, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
        start = cum.get(s, 0)
        cum[s] = start + n
        for p in (0, 1):
            if n and target[s] and start + p * sizes[s] < target[s]:
                copies.append(((start + n + p * sizes[s]) / target[s], i, p, s, n))
    served, taken = 0, {}
    for _, i, _, s, n in sorted(copies, key=lambda c: c[:3]):
        if served < sum(target.values()):
            taken[i] = taken.get(i, 0) + n
        served += n
    return {i: (n, sizes[s], target[s], taken.get(i, 0)) for i, s, n in sized}


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", {"k": 1}) for i, s, t in rows], "doc_id long, source string, text string, size string, stretch map<string,int>")


@pytest.mark.parametrize("skew", [1, 40])
def test_matches_the_sequential_version(spark, skew):
    rows = [(i, f"s{i % 5}" if i % 7 else None, "w " * ((i * 13) % 50) * (skew if i % 5 == 0 else 1)) for i in range(300)]
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.fair_queue(frame(spark, rows)).collect()}
    want = plain_mix(rows)
    assert got.keys() == want.keys()
    for i, (n, total, target, taken) in want.items():
        assert got[i][:2] == (n, total) and got[i][2] == pytest.approx(target) and got[i][3] == taken
        assert got[i][3] <= 2 * n
    by = {}
    for _, s, t in rows:
        by[s] = by.get(s, 0)
    for i, s, _ in rows:
        by[s] += got[i][3]
    for s, total in by.items():
        target = next(want[i][2] for i, x, _ in rows if x == s)
        assert abs(total - target) <= 50 * skew


def test_stretches_do_not_change_the_mix(spark, monkeypatch):
    rows = [(i, f"s{i % 3}", "w " * (1 + i % 9)) for i in range(200)]
    whole = sorted(map(tuple, mixing.fair_queue(frame(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "STRETCH_ROWS", 4)
    assert sorted(map(tuple, mixing.fair_queue(frame(spark, rows)).collect())) == whole


def test_edges(spark):
    assert mixing.fair_queue(frame(spark, [])).count() == 0
    got = mixing.fair_queue(frame(spark, [(1, "a", None), (2, None, ""), (3, "b", "  　")])).collect()
    assert {(r.doc_id, r.size, r.taken) for r in got} == {(1, 0, 0), (2, 0, 0), (3, 2, 4)}
    same = [(7, "a", "x y"), (7, "a", "x y"), (None, "a", "z")]
    got = mixing.fair_queue(frame(spark, same)).collect()
    assert len(got) == 3 and sum(r.taken for r in got) <= 10


def test_documents_of_the_mix_keep_their_columns(spark):
    rows = [(i, f"s{i % 3}" if i else None, "w " * (1 + i % 9)) for i in range(120)] + [(7, "s1", "w " * 8), (7, "s1", "other"), (None, "s0", None), (None, "s0", "a b")]
    docs = frame(spark, rows).withColumnRenamed("stretch", "print")
    got = mixing.mix_documents(docs)
    assert got.columns == ["doc_id", "source", "text", "print", "size", "source_size", "target", "taken", "copies"]
    found = [(r.doc_id, r.source, r.text, r.taken, r.copies) for r in got.collect()]
    queue = mixing.fair_queue(docs).where("copies > 0").groupBy("doc_id", "source", "print", "size").agg({"taken": "sum", "copies": "sum"}).collect()
    assert len(found) == len(queue) and sum(f[3] for f in found) == sum(r["sum(taken)"] for r in queue)
    known = {(i, s, t) for i, s, t in rows}
    assert all(f[:3] in known and f[3] == f[4] * f[2].count(" ") or f[2] in ("other", "a b") for f in found)
    assert [f[4] for f in found if f[0] == 7 and f[2] != "other"] == [sum(r["sum(copies)"] for r in queue if r.doc_id == 7 and r.size == 8)]
    assert mixing.mix_documents(docs.limit(0)).count() == 0
