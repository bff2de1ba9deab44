"""Fill-in-the-middle against a plain reading of its rules."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import fill_middle as fm

TEXTS = ["", "a", "abc def", "x<P>y", "<S>", "no <M> here", "\n\t  é漢字 word\x00w 🙂 end", "1234", "a-b_c." * 50, "<" * 30 + "P>S>M>"[0], "z" * 5000, "é" * 300, "ab <S <M P>"] + [f"text {i} of some words, {i * 7} times\n" * (i % 5 + 1) for i in range(60)]


def plain(doc_id, text):
    text = text or ""
    tokens = re.findall(fm.TOKEN, text)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("piece", [3, 1 << 16])
def test_pieces_do_not_change_a_cut(piece):
    slicer = fm.Slicer(piece=piece)
    for text in TEXTS:
        tokens = re.findall(fm.TOKEN, text)
        ends = [0]
        for t in tokens:
            ends.append(ends[-1] + len(t))
        n, at = slicer.cut(text, lambda n: range(n + 1))
        assert n == len(tokens) and at == ends


def test_every_row_follows_the_rules(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "of no id, some words", "x"), (None, None, "y"), (70, None, "z"), (3, TEXTS[2], "again"), (3, TEXTS[2], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").withColumn("h1", F.lit(1)).withColumn("id", F.lit("clash"))
    found = fm.fill_in_middle(docs).withColumn("back", fm.restored("output", "form")).collect()
    assert sorted(map(str, [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found])) == sorted(map(str, [(i, *plain(i, t)) for i, t, _ in rows]))
    assert sorted(r.back for r in found) == sorted(t or "" for _, t, _ in rows)
    assert {r.form for r in found} == {"plain", "spm", "psm"}


def test_empty_table_and_other_ids(spark):
    assert fm.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    named = spark.createDataFrame([("k", "some text")], "key string, body string")
    assert fm.fill_in_middle(named, "key", "body").columns[0] == "key"


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got = sorted(tuple(r) for r in fm.op13_fill_in_middle(spark, sf).collect())
    assert got == sorted(con.execute(fm.OP13_SQL).fetchall()) and all(r[0] is not None for r in got)
