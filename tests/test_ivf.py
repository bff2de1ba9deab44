"""The inverted-file index against exact search."""

import numpy as np

from quillgraph.operators import ivf
from quillgraph.operators.vectors import knn
from quillgraph.sources import storage


def _clustered(spark, n=2000, width=12, groups=25):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(groups, width)) * 4
    x = middle[rng.integers(0, groups, n)] + rng.normal(size=(n, width))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


def _answers(df):
    return {(r.query_id, r.nth): (r.id, round(r.distance, 9)) for r in df.collect()}


def test_exact_recall_and_pruned_folders(spark, tmp_path):
    df = _clustered(spark)
    queries = df.where("id % 50 = 0").selectExpr("id query_id", "vector query_vector")
    ivf.build(df, str(tmp_path / "x"))
    index = ivf.IvfIndex(spark, str(tmp_path / "x"))
    assert index.rows().count() == 2000 and len(index.names) > 20
    want = _answers(knn(df, queries, 5))
    # One list opened at first: all that is missing must come through the radii.
    assert _answers(ivf.search(index, queries, 5, str(tmp_path / "a"), probes=1, exact=True)) == want
    some = _answers(ivf.search(index, queries, 5, str(tmp_path / "b"), probes=4))
    recall = len({(q, i) for (q, _), (i, _) in some.items()} & {(q, i) for (q, _), (i, _) in want.items()}) / len(want)
    assert recall >= 0.9
    few = index.probed(index.names[:2])
    assert "PartitionFilters: [isnotnull(list" in few._jdf.queryExecution().toString() or "PartitionFilters: [list" in few._jdf.queryExecution().toString()
    assert {r.list for r in few.select("list").distinct().collect()} == set(index.names[:2].tolist())


def test_odd_rows_ties_and_stores(spark, tmp_path):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(3, [1.0, 2.0]), (None, [1.0, 2.5]), (50, None), (51, [1.0, None]), (52, [float("nan"), 0.0]), (53, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    store = storage.open_vector_store("ivf", spark, str(tmp_path / "v"))
    store.load(df)
    assert store.rows().count() == 43
    q = spark.createDataFrame([(7, [1.0, 2.0]), (8, None)], "query_id long, query_vector array<double>")
    got = store.by_vector(q, 5).orderBy("nth").collect()
    assert [(r.query_id, r.id, r.distance) for r in got] == [(7, i, 0.0) for i in (0, 1, 2, 3, 3)]
    assert store.by_vector(q, 100).count() == 43
    assert [r.id for r in store.filter_by_id([53, 9]).by_vector(q, 5).orderBy("nth").collect()] == [9, 53]
    store.load(spark.createDataFrame([(60, [1.0, 2.1])], "id long, vector array<double>"), overwrite=False)
    assert store.rows().count() == 44
    store.load(df.limit(0))
    assert store.by_vector(q, 5).count() == 0


def test_one_pass_takes_many_queries_and_later_lists_give_only_nearer_rows(spark, tmp_path, monkeypatch):
    df = _clustered(spark)
    queries = df.where("id % 3 = 0").selectExpr("id query_id", "vector query_vector")
    ivf.build(df, str(tmp_path / "x"))
    index = ivf.IvfIndex(spark, str(tmp_path / "x"))
    want = _answers(knn(df, queries, 5))
    passes, opened = [], []
    search, bounds = ivf.IvfIndex.search, ivf.IvfIndex._bounds
    monkeypatch.setattr(ivf.IvfIndex, "search", lambda self, block, *a: passes.append(len(block)) or search(self, block, *a))
    monkeypatch.setattr(ivf.IvfIndex, "_bounds", lambda self, *a: opened.append(bounds(self, *a)) or opened[-1])
    # Few distances are held at a time, so a list meets its queries in several parts.
    monkeypatch.setattr(ivf, "HELD", 5000)
    assert _answers(ivf.search(index, queries, 5, str(tmp_path / "a"), probes=1, exact=True)) == want
    assert passes == [667]  # blocks of 500 before
    first, later = (df.count() for df in opened)
    assert first >= 5 * 667 and later < 3 * first
    # The bytes of a block are bounded, whatever the width.
    monkeypatch.setattr(ivf, "QUERY_LISTS", 300 * len(index.names))
    passes.clear()
    assert _answers(ivf.search(index, queries, 5, str(tmp_path / "b"), probes=1, exact=True)) == want
    assert passes == [300, 300, 67]
