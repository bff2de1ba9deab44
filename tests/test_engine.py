"""Operators on small frames, the workflow engine, sources, and every query against its SQL."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgraph.functions import providers as P
from quillgraph.functions import text as T
from quillgraph.functions.session import cut
from quillgraph.operators import context as C
from quillgraph.operators import extraction as X
from quillgraph.operators import graph as G
from quillgraph.operators import raptor, thoughts, tuning
from quillgraph.operators import relational as R
from quillgraph.operators import search as S
from quillgraph.operators import vectors as V
from quillgraph.operators.components import connected_components
from quillgraph.operators.relational import VerbInput
from quillgraph.plans.registry import QUERIES, SQL
from quillgraph.plans.workflow import Pipeline, Step, load_config, resolve
from quillgraph.sources import files, storage

SF = os.environ.get("QUILLGRAPH_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([norm(x) for x in v])
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    if name not in SQL:
        assert rows
        return
    r = duck.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert rows == sorted(tuple(norm(x[i]) for i in order) for x in r.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "target", "weight", "rank"] and df.count() == 20


def test_shuffle_partitions_do_not_change_results(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append([sorted(map(str, QUERIES[q](spark, SF).collect())) for q in ("top_relationships", "agg_arrays", "connected_components", "pack_embed_batches")])
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


# -- relational verbs ------------------------------------------------------------------------------


def test_null_keys_meet_and_groups_drop_them(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    b = spark.createDataFrame([(None, 5), (2, 6)], "k int, v int")
    assert {tuple(r) for r in R.join(VerbInput(a, [b]), ["k"]).collect()} == {(None, 1, 5)}
    assert R.join(VerbInput(a, [b]), ["k"], null_safe=False).count() == 0
    assert [r.k for r in R.anti_join(a, b, "k").collect()] == [1]
    assert [r.k for r in R.aggregate(VerbInput(a), [{"column": "v", "operation": "sum", "to": "s"}], ["k"]).collect()] == [1]
    assert R.aggregate(VerbInput(a), [{"column": "v", "operation": "sum", "to": "s"}]).first().s == 3


def test_unroll_keeps_empty_lists(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "k int, v array<string>")
    assert sorted((r.k, r.v or "") for r in R.unroll(VerbInput(df), "v").collect()) == [(1, ""), (1, "a"), (2, ""), (3, "")]


def test_text_columns(spark):
    df = spark.createDataFrame([("a,b,",), ("",), (None,), (" &lt;x&gt; &amp;lt; \x07 ",)], "t string")
    assert [r[0] for r in df.select(T.split_text(F.col("t"))).collect()] == [["a", "b", ""], [], None, [" &lt;x&gt; &amp;lt; \x07 "]]
    assert df.select(T.clean_str(F.col("t")).alias("c")).collect()[3].c == "<x> &lt; "
    assert [r[0] for r in df.select(T.num_tokens(F.col("t"))).collect()] == [1, 0, 0, 3]
    assert df.select(T.fill_template("{a}-{b}", {"a": F.lit(1), "b": F.lit(None)}).alias("x")).first().x == "1-"
    assert df.select(T.parse_rating(F.lit("x")).alias("a"), T.parse_rating(F.lit("7.5")).alias("b")).first() == (-1.0, 7.5)


@pytest.mark.parametrize("n,want", [(0, []), (1, [1]), (4, [4, 1]), (5, [4, 2]), (7, [4, 4, 1])])
def test_windows(spark, n, want):
    df = spark.createDataFrame([(1, " ".join("w" * 1 for _ in range(n)))], "doc_id long, text string")
    assert [r.n_tokens for r in T.token_windows(df, ["doc_id"], "text", "doc_id", 4, 1).orderBy("chunk_no").collect()] == want
    with pytest.raises(ValueError):
        T.token_windows(df, ["doc_id"], "text", "doc_id", 4, 4)


def test_grouped_windows_name_their_documents(spark):
    df = spark.createDataFrame([(1, "g", "a b c"), (2, "g", "d"), (3, "g", None), (4, "g", "e f")], "id long, g string, text string")
    rows = T.token_windows(df, ["g"], "text", "id", 4, 1).orderBy("chunk_no").collect()
    assert [(r.chunk, r.document_ids) for r in rows] == [("a b c d", ["1", "2"]), ("d e f", ["2", "4"])]


def test_verbs_reject_unknown_operations(spark):
    df = spark.range(1).withColumnRenamed("id", "a")
    for call in (lambda: R.derive(VerbInput(df), "x", "a", "^", "a"), lambda: R.predicate(df, "a", "?"), lambda: R.aggregation("?", "a"), lambda: R.genid(VerbInput(df), "x"), lambda: R.window(VerbInput(df), "?", "x")):
        with pytest.raises(ValueError):
            call()


# -- graphs ------------------------------------------------------------------------------------------


def edges(spark, rows, schema="source string, target string"):
    return spark.createDataFrame(rows, schema)


def test_degree_and_components(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("l", "l"), ("m", "n"), ("n", "o")])
    assert {tuple(r) for r in G.node_degree(e).collect()} == {("a", 1), ("b", 2), ("c", 1), ("x", 1), ("y", 1), ("l", 2), ("m", 1), ("n", 2), ("o", 1)}
    assert {tuple(r) for r in G.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("l", "l"), ("m", "m"), ("n", "m"), ("o", "m")}
    assert {r.source for r in G.largest_component(e).collect()} == {"a", "b"}  # equal size: smaller name
    chain = spark.range(60).selectExpr("id as src", "id + 1 as dst")
    assert connected_components(chain).agg(F.max("component"), F.count("*")).first() == (0, 61)
    assert connected_components(chain.limit(0)).count() == 0


def test_communities(spark):
    clique = lambda names: [(a, b) for i, a in enumerate(names) for b in names[:i]]
    e = edges(spark, [*clique("abcde"), *clique("vwxyz"), ("a", "v")])
    parts = G.detect_communities(e, None, 4, 1)
    found = {r.node: r.community for r in parts.collect()}
    assert len({found[n] for n in "abcde"}) == len({found[n] for n in "vwxyz"}) == 1 and found["a"] != found["v"]
    assert G.modularity(e, parts) > 0.4
    levels = G.hierarchical_communities(e, 3, 2, None, rounds=2, passes=1).collect()
    assert {r.level for r in levels} == {0, 1}
    parent = {r.node: r.community for r in levels if r.level == 0}
    assert all(r.parent == parent[r.node] for r in levels if r.level == 1)


def test_hierarchy_needs_containment(spark):
    m = spark.createDataFrame([(0, "A", "x"), (0, "A", "y"), (0, "B", "z"), (2, "C", "x"), (2, "C", "y"), (2, "D", "y2"), (2, "E", "x"), (2, "E", "z"), (2, None, "q")], "level int, community string, title string")
    assert {tuple(r) for r in G.community_hierarchy(m).collect()} == {(0, "A", 2, "C", 2)}


def test_merge_folds(spark):
    df = spark.createDataFrame([("n", 1, "b", None), ("n", 2, "a,b", 0), ("n", 3, None, 4), ("one", 1, "z,a", 5)], "title string, ord int, d string, w int")
    got = {r.title: r for r in G.merge_graph(df.withColumn("p", F.col("w")).withColumn("m", F.col("w")), ["title"], "ord", {"d": {"operation": "concat", "distinct": True}, "w": "sum", "p": "multiply", "*": "min"}).collect()}
    assert got["n"].d == ",a,b" and got["n"].w == 4 and got["n"].p == 4 and got["n"].m == 0 and got["one"].d == "z,a"


def test_walks_and_layout(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    walks = G.random_walks(e, 2, 6).collect()
    assert len(walks) == 6 and all(len(r.path) == 6 and r.path[0] == r.node for r in walks)
    v = spark.createDataFrame([(i, [float(i), 1.0, i * 2.0]) for i in range(6)], "node long, embedding array<double>")
    assert G.layout_pca(v).count() == 6


# -- contexts ------------------------------------------------------------------------------------------


def test_budgets(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, 3), (4, 9)], "o int, c long")
    assert [r.o for r in C.within_budget(df, "c", 8, ["o"]).orderBy("o").collect()] == [1, 2, 3]
    assert C.within_budget(df, "c", 4, ["o"]).count() == 0
    assert [r.o for r in C.within_budget(df, "c", 6, ["o"], include_overflow=True).orderBy("o").collect()] == [1, 2, 3]
    packed = C.pack_batches(spark.createDataFrame([(0, i, c) for i, c in enumerate([5, 4, 3, 8, 1, 20, 1])], "g int, o int, c long"), ["g"], "o", "c", 9)
    assert [r.batch for r in packed.orderBy("o").collect()] == [0, 0, 1, 2, 2, 3, 4]


def test_turns(spark):
    t = spark.createDataFrame([(1, 0, "bot", "hi"), (1, 1, "user", "q1"), (1, 2, "user", "q2"), (1, 3, "system", "s"), (1, 4, "bot", "a")], "conv_id long, turn long, role string, text string")
    assert [tuple(r)[1:] for r in C.qa_turns(t).orderBy("qa").collect()] == [(1, "q1", ""), (2, "q2", "s\na")]
    assert C.history_context(t, 1, 100).first().context == "user|q2\nsystem|s\na"
    assert C.qa_turns(t.limit(0)).count() == 0


def test_mixed_context(spark):
    rows = [("c", "s1", "r1", "w " * 10, 10), ("c", "s2", None, "v " * 6, 6), ("c", "s3", "r3", "u " * 5, 5)]
    subs = spark.createDataFrame([(a, b, r, x.strip(), n) for a, b, r, x, n in rows], "community string, sub_community string, report string, context string, context_size int")
    text = lambda budget: C.mixed_context(subs, budget).first().mixed
    assert text(100).split("\n")[0] == "r1" and text(12).split("\n")[0] == "r1"
    assert text(8) == "r1\n" + " ".join("v" * 6) + "\nr3"
    assert text(1) == "r1"


def test_search(spark):
    with pytest.raises(ValueError):
        S.local_search_context(*[spark.range(1)] * 4, None, community_prop=0.6, text_unit_prop=0.5)
    points = spark.createDataFrame([(0, "a", 5.0), (1, "b", 0.0), (1, "c", 9.0)], "batch long, description string, score double")
    assert [r.description for r in S.reduce_points(points, 1000).orderBy("place").collect()] == ["c", "a"]
    reports = spark.createDataFrame([(1, "t", "c", 1.0, 1.0)], "community int, title string, content string, weight double, rank double")
    none = P.StaticProvider(response='{"points": []}')
    assert S.global_search(reports, "q", none, none).first().answer == S.NO_DATA
    q = spark.createDataFrame([("- one\n\n* two",)], "a string")
    assert [r.question for r in S.question_candidates(q, "a").orderBy("nth").collect()] == ["one", "two"]


# -- vectors, trees, thoughts, providers ---------------------------------------------------------------


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vector array<double>")
    assert [(r.id, r.distance) for r in V.knn(df, q, 2, "l2").orderBy("nth").collect()] == [(1, 0.0), (2, 0.0)]
    assert V.knn(df, q.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        V.distance(F.col("vector"), F.col("vector"), "?")
    pieces = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [3.0, 4.0]), ("b", [3.0, 4.0])], "k string, v array<double>")
    assert {r.k: r.embedding for r in V.reconstitute(pieces, "k", "v").collect()} == {"a": [3.0, 4.0], "b": [0.6, 0.8]}


def test_text_tree(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Sentence number {i}. Another one here, with, commas; {i}. End {i}!") for i in range(12)] + [(90, ""), (91, None)], "id long, text string")
    tree = raptor.TextTree(lambda c: P.hash_embedding(c, 6), lambda c: F.concat(F.lit("about "), F.substring(c, 1, 30)), lambda ctx, q: f"{len(ctx) > 0} {q}")
    tree.add_documents(docs, "id", "text", 8, layers=1, dimensions=3, max_clusters=2)
    assert tree.nodes.agg(F.max("layer")).first()[0] >= 1
    assert tree.edges.join(tree.nodes, F.col("parent") == F.col("idx"), "left_anti").count() == 0
    assert tree.answer_question("who?", top_k=3) == "True who?"
    assert tree.retrieve("who?", top_k=2, collapse=False).count() >= 2
    tree.save(str(tmp_path / "t"))
    n = tree.nodes.count()
    tree.load(spark, str(tmp_path / "t"))
    assert tree.nodes.count() == n


def test_thoughts(spark):
    t = thoughts.thoughts(spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "id string, v int"), "id", F.create_map(F.lit("v"), F.col("v").cast("string")))
    with pytest.raises(Exception, match="not scored"):
        thoughts.keep_best(t, 1).collect()
    s = thoughts.score(t, F.col("state")["v"].cast("double"))
    assert [r.id for r in thoughts.keep_best(s, 2).collect()] == ["b", "c"]
    assert thoughts.aggregate(s).first().state == {"v": "2"}
    v = thoughts.validate_and_improve(s, F.col("state")["v"] == "2", F.create_map(F.lit("v"), F.lit("2")), 2)
    assert thoughts.keep_valid(v).count() == 3
    g = thoughts.ThoughtGraph().append("gen", lambda d: thoughts.generate(d, F.array(F.create_map(F.lit("k"), F.lit("1"))))).append("score", lambda d: thoughts.score(d, F.lit(1))).append("best", lambda d: thoughts.keep_best(d, 1))
    assert g.execute(s)["best"].first().state == {"v": "1", "k": "1"}
    assert thoughts.ground_truth(s, F.col("state")["missing"] == "1").where("solved").count() == 0


def test_states_of_a_large_group_fold_entry_by_entry(spark):
    import random

    r = random.Random(5)
    rows = [(k, f"{i:05d}", {r.choice("abcd"): r.choice(["x", "y", None]) for _ in range(r.randint(0, 3))}, r.choice([None, -1.0, 0.0, 2.5])) for k in (1, None) for i in range(200)]
    rows += [(2, f"{i:05d}", {"last": f"{i:05d}", f"k{i % 3}": "v"}, float(i % 777)) for i in range(20000)]
    rows += [(3, "a", None, 1.0), (3, "b", {"only": "b"}, 0.0), (4, "a", {}, 1.0)]
    want = {}
    for k, i, state, score in sorted(rows, key=lambda x: (x[3] or 0.0, x[1])):
        want.setdefault(k, {}).update(state or {})
    t = spark.createDataFrame(rows, "key int, id string, state map<string,string>, score double")
    assert {x.key: x.state for x in thoughts.aggregate(t, ["key"]).collect()} == want
    assert thoughts.aggregate(t.limit(0)).first().state == {}
    # A sort of all states of a group in one row was compared entry by entry with all later ones.
    plan = thoughts.aggregate(t, ["key"])._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan and "slice" not in plan


def test_providers(spark):
    with pytest.raises(ValueError):
        P.StaticProvider()("x")
    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert P.Retry(flaky, 5, 0.001)("p") == "ok" and len(calls) == 3
    assert P.Valid(lambda p: p, lambda a: a.endswith("2"), 3)("q") == "q\n\n2"
    prompts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "p string")
    answers, fresh = P.ask(prompts, "p", P.StaticProvider(["x"]))
    assert fresh.count() == 2 and answers.where("answer = 'x'").count() == 3
    again, none = P.ask(prompts, "p", P.ReplayProvider({}), fresh)
    assert none.count() == 0 and again.where("answer = 'x'").count() == 3


# -- workflows and files -------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    data = spark.createDataFrame([("A", 2, 4), ("A", 5, 10), ("A", 15, 26), ("B", 6, 25)], "type string, col1 long, col2 long")
    verbs = {"str_append": lambda t, source, target, text: t.source.withColumn(target, F.concat(F.col(source), F.lit(text)))}
    flows = {"derived": lambda c: [{"verb": "derive", "args": {"to": "col3", "column1": "col1", "operator": "*", "column2": "col2"}}, {"verb": "nothing", "enabled": False}]}
    wanted = [
        {"name": "last", "steps": [{"verb": "str_append", "args": {"source": "type", "target": "t2", "text": "!"}, "input": "workflow:sums"}]},
        {"name": "sums", "steps": [{"verb": "aggregate", "args": {"groupby": "type", "column": "col3", "operation": "sum", "to": "total"}, "input": {"source": "workflow:derived"}}]},
    ]
    assert [w.name for w in resolve(wanted, flows)] == ["derived", "sums", "last"]
    p = Pipeline(spark, str(tmp_path), verbs, flows, ("json", "csv"))
    got = {r.workflow: r for r in p.run(wanted, data)}
    assert {tuple(r) for r in got["last"].table.collect()} == {("A", 448, "A!"), ("B", 150, "B!")}
    p.write_stats()
    assert spark.read.text(f"{tmp_path}/stats.json").count() == 1 and spark.read.json(f"{tmp_path}/sums.json").count() == 2
    again = list(Pipeline(spark, str(tmp_path), verbs, flows).run(wanted, data.limit(0), resume=True))
    assert again[-1].table.count() == 2
    bad = list(p.run([{"name": "x", "steps": [Step("unknown")]}], data))
    assert isinstance(bad[0].errors[0], ValueError)
    with pytest.raises(ValueError, match="circle"):
        resolve([{"name": "a", "steps": [Step("select", input="workflow:b")]}, {"name": "b", "steps": [Step("select", input="workflow:a")]}], {})
    with pytest.raises(ValueError, match="unknown workflow"):
        resolve(["nope"], {})
    sampled = list(p.run([{"name": "s", "steps": [Step("select", {"columns": ["col1"]})]}], data, post_process=[Step("sample", {"size": 2, "key": "col1"})]))
    assert sampled[0].table.count() == 2


def test_config():
    base = '{"a": {"x": 1, "y": 2}, "w": [{"include": "w1"}]}'
    got = load_config('{"extends": "base", "a": {"y": 3}}', {"base": base, "w1": '{"name": "one"}'})
    assert got == {"a": {"x": 1, "y": 3}, "w": [{"name": "one"}]}


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "2024-01-x.txt").write_text("one\ntwo")
    (tmp_path / "in" / "sub" / "2023-05-y.txt").write_text("three")
    (tmp_path / "in" / "skip.md").write_text("no")
    pattern = r".*[\\/](?P<year>\d{4})-(?P<month>\d\d)-(?P<name>[a-z]+)\.txt$"
    rows = {r.title: r for r in files.read_texts(spark, str(tmp_path / "in"), pattern).collect()}
    assert rows.keys() == {"2024-01-x.txt", "2023-05-y.txt"} and rows["2024-01-x.txt"].text == "one\ntwo" and rows["2023-05-y.txt"].year == "2023"
    assert [r.name for r in files.read_texts(spark, str(tmp_path / "in"), pattern, {"year": "2024"}).collect()] == ["x"]
    assert files.find_files(spark, str(tmp_path / "in"), pattern, max_count=1).count() == 1
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text("author,message,at\nann,hello,20240203040506\n")
    r = files.read_csv(spark, str(tmp_path / "c"), source="author", text="message", timestamp="at", timestamp_format="yyyyMMddHHmmss").first()
    assert (r.source, r.text, r.year, r.day, r.second) == ("ann", "hello", 2024, 3, 6) and len(r.id) == 32
    with pytest.raises(ValueError):
        files.load_input(spark, "pdf", "x")
    df = spark.createDataFrame([("a", [1.0]), ("b", None)], "id string, vector array<double>")
    files.write_vectors(df, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    files.emit(df, str(tmp_path), "t", ("csv",))
    files.snapshot_rows(df, str(tmp_path / "rows"), "r", "id", "id")
    assert spark.read.text(str(tmp_path / "rows" / "json")).count() == 2


def test_property_graph(spark):
    t = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", None)], "o int, s string, t string")
    assert files.table_edges(t, "s", "t", "R", ["o"]).count() == 2
    assert [(r.src, r.dst) for r in files.chain_edges(t, "s", ["o"]).orderBy("src").collect()] == [("a", "b"), ("b", "c")]
    store = spark.createDataFrame([("k", "old", "keep", 1, 1)], "id string, x string, y string, at int, count long")
    new = spark.createDataFrame([("k", "new", None, 2, 1), ("m", "z", None, 2, 1)], "id string, x string, y string, at int, count long")
    merged = files.upsert(store, new, "id", "at")
    assert {(r.id, r.x, r.y, r["count"]) for r in merged.collect()} == {("k", "new", "keep", 2), ("m", "z", None, 1)}
    assert [r.id for r in files.decay(merged).collect()] == ["k"]


def test_streams(spark, tmp_path):
    from quillgraph.streaming.incremental import event_windows, incremental_windows

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.limit(20).write.parquet(str(tmp_path / "in"))
    q = incremental_windows(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), 50, 10)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() > 0
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.limit(200).write.parquet(str(tmp_path / "ev"))
    s = event_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev")))
    w = s.writeStream.outputMode("complete").format("memory").queryName("ev").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.sql("select sum(events) from ev").first()[0] == 200


def test_cut_uses_the_shared_folder(spark):
    assert cut(spark.range(3)).count() == 3 and spark.sparkContext.getCheckpointDir()


def test_library_does_not_import_the_training_data_operators():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(here, "quillgraph")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "quillgraph.llm" not in open(os.path.join(folder, n)).read()


@pytest.mark.parametrize("gone", [["quillgraph/llm"], ["quillgraph/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_imports_without_the_optional_parts(tmp_path, gone):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), set(s) <= set(q), 'pipeline' in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, fits, pipeline = done.stdout.split()
    assert int(n) >= len(QUERIES) and fits == "True" and pipeline == "False"


# -- verbs that ask a provider -------------------------------------------------------------------------


def test_extraction_and_gleanings(spark):
    class Glean:
        def __call__(self, prompt):
            return '("entity"<|>b<|>X<|>late)' if "left out" in prompt else '("entity"<|>a<|>X<|>first)##("entity"<|>a<|>X<|>again)##("relationship"<|>c<|>a<|>near<|>3)##("relationship"<|>a<|>c<|>near<|>1)##<|COMPLETE|>'

    units = spark.createDataFrame([(1, "t"), (2, None)], "u long, text string")
    e, r = X.entity_extract(units, "u", "text", Glean(), gleanings=1)
    got = {(x.u, x.name): (x.type, x.descriptions) for x in e.collect()}
    assert got[1, "A"] == ("X", ["again", "first"]) and got[1, "B"] == ("X", ["late"]) and got[1, "C"] == (None, [])
    assert [tuple(x) for x in r.where("u = 1").collect()] == [(1, "A", "C", ["near"], 4.0)]
    assert X.entity_extract(units, "u", "text", Glean(), types=["y"])[0].where("type is not null").count() == 0


def test_summaries_fold_under_the_budget(spark):
    class Count:
        def __call__(self, prompt):
            return f"sum{len(prompt.splitlines()) - 1}"

    rows = spark.createDataFrame([("k", w * 1) for w in ("b b b", "a a a", "c c c", "a a a")] + [("one", "x"), ("none", None), (None, "y")], "k string, d string")
    got = {r.k: (r.n, r.summary) for r in X.summarize_descriptions(rows, ["k"], "d", Count(), 7).collect()}
    assert got == {"k": (3, "sum2"), "one": (1, "x"), "none": (0, ""), None: (1, "y")}
    assert X.summarize_descriptions(rows.limit(0), ["k"], "d", Count()).count() == 0


def test_typed_rows_and_lookups(spark):
    rows = spark.createDataFrame([("1", "a,b", "u-1"), ("2", None, "u2")], "id string, tags string, key string")
    got = X.typed(rows, {"id": "int"}, {"tags": "array<string>", "rank": "int"}).collect()
    assert [tuple(r) for r in got] == [(1, ["a", "b"], None), (2, None, None)]
    with pytest.raises(ValueError):
        X.typed(rows, {"title": "string"})
    with pytest.raises(Exception, match="no int"):
        X.typed(rows, {"key": "int"}).collect()
    assert X.by_key(rows, "key", ["u1"]).count() == 1 and X.by_key(rows, "key", ["u-2"]).count() == 1
    assert X.by_attribute(rows.selectExpr("id", "map('k', id) as m"), "m", "k", "2").count() == 1


def test_answers_are_kept(spark, tmp_path):
    folder = str(tmp_path / "cache")
    prompts = spark.createDataFrame([("p",), ("q",)], "prompt string")
    _, fresh = P.ask(prompts, "prompt", P.StaticProvider(["yes"]), P.read_cache(spark, folder))
    P.write_cache(fresh, folder)
    answers, fresh = P.ask(prompts.union(prompts.limit(0)), "prompt", P.StaticProvider(["no"]), P.read_cache(spark, folder))
    assert fresh.count() == 0 and {r.answer for r in answers.collect()} == {"yes"}


def test_packing_carries_rows_and_state(spark):
    rows = spark.createDataFrame([(g, i, (i * 7) % 5) for g in (1, 2) for i in range(5000)], "g int, o int, c long").withColumn("extra", F.col("o") * 2)
    got = C.pack_batches(rows, ["g"], "o", "c", 11).collect()
    assert len(got) == 10000 and all(r.extra == 2 * r.o for r in got)
    for g in (1, 2):
        batch = used = n = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.o):
            if n and used + r.c > 11:
                batch, used, n = batch + 1, 0, 0
            used, n = used + r.c, n + 1
            assert r.batch == batch
    reports = spark.createDataFrame([(1, "t", "c", 1.0, 1.0)] * 2 + [(1, "u", "c", 1.0, 1.0)], "community int, title string, content string, weight double, rank double")
    assert S.report_batches(reports, 100).count() == 3


def test_pair_counts_are_those_of_all_pairs(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, ["x"])], "k int, names array<string>")
    assert sorted(map(tuple, G.pair_counts(rows, ["k"], "names").collect())) == [(1, "a", "b", 3), (1, "b", "b", 3)]


def test_json_out_of_answers(spark):
    rows = [('Sure! ```json\n{"a": "b"}\n``` done',), ('{"a": "b"}',), ('text {"a": "b"} tail',), ('{\\"a\\": \\"b\\"}',), ('{{"a": "b"}}',)]
    got = spark.createDataFrame(rows, "t string").select(F.from_json(T.clean_json(F.col("t")), "a string")["a"].alias("a")).collect()
    assert [r.a for r in got] == ["b"] * 5


def test_two_stage_and_bounded_clusters(spark, monkeypatch):
    # Rows by the sign of a coordinate stand for a mixture: the stages are under test, not the fit.
    def halves(df, id_col, vector, dimensions=1, threshold=0.1, max_clusters=2):
        at = F.get(vector, F.lit(0))
        mean = df.agg(F.avg(at)).first()[0]
        return df.select(id_col, F.when(at > mean, 1).otherwise(0).alias("cluster"))

    monkeypatch.setattr(raptor, "cluster_nodes", halves)
    df = spark.createDataFrame([(i, [float(i)], "w " * 30) for i in range(32)], "id long, v array<double>, text string")
    found = raptor.two_stage_clusters(df, "id", "v")
    assert sorted(r["count"] for r in found.groupBy("cluster").count().collect()) == [8, 8, 8, 8]
    fine = raptor.bounded_clusters(df, "id", "v", "text", max_tokens=100)
    assert sorted(r["count"] for r in fine.groupBy("cluster").count().collect()) == [2] * 16 and fine.count() == 32
    same = raptor.bounded_clusters(df.withColumn("v", F.array(F.lit(1.0))), "id", "v", "text", max_tokens=100)
    assert same.select("cluster").distinct().count() == 1 and same.count() == 32


def test_communities_are_split_until_small(spark):
    chain = [(i, i + 1) for i in range(24)]
    edges = spark.createDataFrame(chain, "source long, target long")
    found = G.hierarchical_communities(edges, 8, weight=None, rounds=3, passes=1)
    sizes = {}
    for r in found.collect():
        sizes.setdefault((r.level, r.community), set()).add(r.node)
    parents = {r.parent for r in found.collect()}
    assert all(len(v) <= 8 for (_, c), v in sizes.items() if c not in parents)


def test_repeated_rows_get_ids_of_their_own(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    ids = [r.id for r in R.window(VerbInput(rows), "uuid", "id").collect()]
    assert len(set(ids)) == 3


def test_paced_provider():
    import time

    p = P.Paced(P.StaticProvider(["a b"]), calls_per_minute=6000, tokens_per_minute=60_000)
    begin = time.monotonic()
    for _ in range(6):
        p("one two")
    assert 0.04 < time.monotonic() - begin < 2


# -- storages, tuning ----------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["folder", "memory"])
def test_storages(spark, tmp_path, kind):
    store = storage.open_storage(kind, spark, str(tmp_path / "s"))
    assert store.get("a.txt") is None and not store.has("a.txt") and list(store.find("."))== []
    store.set("a.txt", "é\n1")
    store.set("in/b-7.txt", "")
    assert store.get("a.txt") == "é\n1" and store.has("in/b-7.txt") and store.child("in").has("b-7.txt")
    assert [(n, g) for n, g in store.find(r"b-(?P<n>[0-9]+)\.txt$")] == [("in/b-7.txt", {"n": "7"})]
    store.delete("a.txt")
    assert not store.has("a.txt")
    store.write_table("t", spark.range(3))
    assert store.read_table("t").count() == 3
    with pytest.raises(ValueError):
        storage.open_storage("tape")
    if kind == "folder":
        with pytest.raises(ValueError):
            store.get("../x")
        assert storage.MemoryStorage(store).get("in/b-7.txt") == ""


def test_vector_store(spark, tmp_path):
    store = storage.open_vector_store("parquet", spark, str(tmp_path / "v"))
    embed = lambda c: F.array(F.length(c).cast("double"), F.lit(0.0))
    store.load(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)] + [(9, None)], "id int, vector array<double>"))
    assert [r.id for r in store.by_text("abc", embed, 2).orderBy("nth").collect()] == [3, 2]
    assert [r.id for r in store.filter_by_id([0, 5]).by_text("abc", embed, 1).collect()] == [5]
    assert store.by_text(" ", embed, 2).count() == 0


def test_prompts_are_fitted_to_a_corpus(spark):
    chunks = spark.createDataFrame([(i, f"text {i}", [float(i)]) for i in range(30)], "id int, text string, v array<double>")
    assert [r.id for r in tuning.choose_texts(chunks, "id", "top", 3).collect()] == [0, 1, 2]
    once = [r.id for r in tuning.choose_texts(chunks, "id", "random", 5).collect()]
    assert once == [r.id for r in tuning.choose_texts(chunks.repartition(3), "id", "random", 5).collect()] and once != [0, 1, 2, 3, 4]
    assert {r.id for r in tuning.choose_texts(chunks, "id", "auto", 3, vector="v", subset=30).collect()} <= {13, 14, 15, 16}
    asked = []
    found = tuning.describe_corpus(["a", "b"], lambda p: asked.append(p) or f"answer {len(asked)} ")
    assert list(found) == list(tuning.QUESTIONS) and "answer 1" in asked[2] and "a\n\nb" in asked[0]
    examples = spark.createDataFrame([(i, "one two", "three") for i in range(5)], "i int, input string, output string")
    assert tuning.fitting_examples(examples, "i", 10, 17).count() == 2 and tuning.fitting_examples(examples, "i", 10, 5).count() == 1
    assert tuning.example_block(tuning.fitting_examples(examples, "i", 10, 17)).startswith("Example 1\none two\nOutput\nthree\n\nExample 2")


def test_context_helpers(spark):
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    rows = spark.createDataFrame([("a", [1, 2], 1), ("c", [3], None), ("c", [3], None), ("d", [], 2)], "t string, ids array<int>, level int")
    assert [r.t for r in C.touched_by(edges, rows, "t").collect()] == ["a"]
    assert sorted(r.t for r in C.holding_ids(rows, "ids", spark.createDataFrame([(3,), (2,)], "k int"), "k").collect()) == ["a", "c", "c"]
    assert [r.level for r in C.levels_of(rows).collect()] == [2, 1]
    assert [r.in_context for r in C.flag_in_context(rows, edges.withColumnRenamed("source", "t"), "t").orderBy("t").collect()] == [True, False, False, False]


def test_provider_verbs_run_in_workflows(spark, tmp_path):
    provider = P.MentionProvider()
    steps = [
        {"verb": "chunk", "args": {"column": "text", "id_column": "id", "size": 4, "overlap": 0}},
        {"verb": "entity_extract", "args": {"column": "chunk", "id_column": "id", "provider": provider}},
        {"verb": "unroll", "args": {"column": "descriptions"}},
        {"verb": "summarize_descriptions", "args": {"keys": ["name"], "column": "descriptions", "provider": P.StaticProvider(["both"])}},
    ]
    docs = spark.createDataFrame([(1, "Ada met Bob"), (2, "Bob left")], "id long, text string")
    done = list(Pipeline(spark, str(tmp_path)).run([{"name": "w", "steps": steps}], docs))
    assert not done[-1].errors, done[-1].errors
    assert sorted((r.name, r.n) for r in done[-1].table.collect()) == [("ADA", 1), ("BOB", 1)]
    out = X.text_embed_verb(VerbInput(docs.unionByName(docs.limit(0).selectExpr("id", "text")).withColumn("e", F.lit(1))), "text", "id", lambda c: F.array(F.length(c).cast("double")))
    assert sorted((r.id, r.embedding) for r in out.collect()) == [(1, [11.0]), (2, [8.0])]


def test_mixtures_of_all_sizes_are_fitted_in_few_sweeps(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [9, 0, 1], [0, 9, 2], [9, 9, 3]])
    rows = [(i, [float(v) for v in centres[i % 4] * 0.01 + r.normal(0, 0.004, 3) + 5]) for i in range(1200)] + [(9999, None)]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    real, sweeps = raptor._sweep, []
    monkeypatch.setattr(raptor, "_sweep", lambda *a: sweeps.append(1) or real(*a))
    found = raptor.soft_clusters(df, "id", "x", 0.1, 20).collect()
    # One fit after the other took a job for every sweep of every number of clusters.
    assert 1 < len(sweeps) <= raptor.SWEEPS + 1
    of = {}
    for row in sorted(found, key=lambda q: q.probability):
        of[row.id] = row.cluster
    groups = [{of[i] for i in range(1200) if i % 4 == g} for g in range(4)]
    assert sorted(of) == list(range(1200)) and all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4
    assert sorted(map(tuple, raptor.soft_clusters(df.repartition(1), "id", "x", 0.1, 20).select("id", "cluster").collect())) == sorted((q.id, q.cluster) for q in found)
    one = spark.createDataFrame([(i, [1.0, float(v)]) for i, v in enumerate(r.normal(size=300))], "id long, x array<double>")
    assert {q.cluster for q in raptor.soft_clusters(one, "id", "x", 0.1, 6).collect()} == {0}
    assert raptor.soft_clusters(df.where("id = 9999"), "id", "x").count() == 0
    assert [tuple(q) for q in raptor.soft_clusters(df.where("id = 1"), "id", "x").collect()] == [(1, 0, 1.0)]


def test_text_unit_order_counts_ends_of_selected_entities_only(spark):
    from quillgraph.operators import context

    e = spark.createDataFrame([(1, 2), (2, 1), (3, 9)], "entity long, entity_order int")
    u = spark.createDataFrame([(10, 1), (10, 2), (10, 2), (11, 7), (12, 3), (13, None)], "unit long, entity long")
    x = spark.createDataFrame([(10, 2, 5), (10, 2, 2), (10, 1, 2), (10, 1, 5), (11, 7, 7), (12, 8, 9), (None, 1, 1)], "unit long, source long, target long")
    got = context.text_unit_order(e, u, x)
    assert sorted(map(tuple, got.collect())) == [(10, 1, 3), (12, 9, 0)]
    # Edges were counted for every end before the selected entities met them.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_sink_edges_are_told_apart_by_their_ends_only(spark):
    from quillgraph.sources.files import index_graph

    docs = spark.createDataFrame([("d", ["u", "u"]), ("d", ["u"])], "id string, text_unit_ids array<string>")
    units = spark.createDataFrame([("u", ["e", "f"], ["r"]), ("u", ["e"], None)], "id string, entity_ids array<string>, relationship_ids array<string>")
    entities = spark.createDataFrame([("e", "E"), ("f", "F")], "id string, name string")
    got = index_graph(docs, units, entities, spark.createDataFrame([("r", "E", "F"), ("r", "E", "F")], "id string, source string, target string"))
    assert sorted((r.src, r.relation, r.dst) for r in got.collect()) == [("d", "HAS", "u"), ("r", "CONNECTS", "e"), ("r", "CONNECTS", "f"), ("u", "MENTIONS", "e"), ("u", "MENTIONS", "f"), ("u", "STATES", "r")]
    # The constants of each kind went through the shuffle with every edge.
    assert "Aggregate [src_type" not in got._jdf.queryExecution().optimizedPlan().toString()
    from quillgraph.operators import graph

    lists = graph.pair_lists(spark.createDataFrame([(1, ["b", "a", "a"]), (2, [])], "id int, names array<string>"), ["id"], "names").collect()
    assert {r.id: [tuple(p) for p in r.pairs] for r in lists} == {1: [("a", "a", 1), ("a", "b", 2)], 2: []}
