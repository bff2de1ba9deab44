"""The corpus pipeline stage by stage against plain expectations, and the registered queries."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from quillgraph.llm.spans import pii_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Twins of some rows: an exact copy under another id, and a repeated row.
    extra = docs.limit(5).selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(extra).unionByName(docs.limit(2))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(name)
        if k < 4:
            assert docs.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 0:
            assert docs.count() > 0.98 * before.count()
        if k == 1:
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and not any(i >= 1000000 for i in ids)
        if k == 3:
            assert docs.count() == before.count()
            rows = docs.select("text").collect()
            # What is left resembles nothing: masks may only join digits that were apart before.
            assert sum(bool(pii_spans(r.text or "")) for r in rows) == 0
    assert seen == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "PII", "mixing sources"]
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken", "copies"]
    masked = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    out = docs.collect()
    assert all(r.text == masked[r.doc_id] and r.taken == r.size * r.copies for r in out) and len({r.doc_id for r in out}) == len(out)
    assert any("<email>" in (r.text or "") for r in out)
    total = docs.selectExpr("sum(taken) as t").first().t
    words = spark.read.parquet(str(tmp_path / "3")).selectExpr("sum(size(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> ''))) as w").first().w
    assert total == pytest.approx(1.5 * words, rel=0.05)


def test_near_copies_beside_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1), (2, "a b c d e f", 2), (3, "x", 3), (3, "x", 3), (None, None, 4), (4, "a b", 5), (4, "a c", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").selectExpr("*", "k as row", "k as key", "map('a', k) as m")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.k) for r in got.collect()) == [(0, 4), (1, 1), (3, 3), (4, 5), (4, 6)]


def test_rows_of_one_id_that_are_no_copies_stay(spark):
    a, b, c = ("lorem ipsum dolor sit amet " * 4, "quite another text of one id here", "a third text that has no like")
    rows = [(1, a), (1, b), (1, b), (2, a), (2, c), (3, b), (None, a), (None, b), (5, ""), (5, None), (5, "")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, a), (1, b), (2, c), (None, a), (None, b), (5, ""), (5, None), (5, "")]))
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], "doc_id long, text string"), SF).collect() == []


def test_registered():
    known = entry.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in known)] == [] and "pipeline" in known
    assert set(entry.oracle_sql()) <= set(known)
