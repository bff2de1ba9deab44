"""Queries of budgets, conversations, vectors, parsers, search, trees and thoughts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import providers as P
from quillgraph.functions import text as T
from quillgraph.functions.session import cut, shared_dir, table
from quillgraph.operators import context as C
from quillgraph.operators import extraction as X
from quillgraph.operators import ivf, raptor, thoughts
from quillgraph.operators import search as S
from quillgraph.operators import vectors as V
from quillgraph.plans.registry import query
from quillgraph.streaming.turns import replay

# -- budgets ---------------------------------------------------------------------------------------

_COST = "len(regexp_extract_all(text, '\\S+'))"


@query(f"WITH c AS (SELECT source, doc_id, CAST({_COST} AS BIGINT) AS cost FROM documents), r AS (SELECT *, CAST(5 + sum(cost) OVER (PARTITION BY source ORDER BY cost, doc_id) AS BIGINT) AS running_tokens FROM c) SELECT * FROM r WHERE running_tokens <= 2000")
def budget_prefix_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", T.num_tokens(F.col("text")).alias("cost"))
    return C.within_budget(docs, "cost", 2000, ["cost", "doc_id"], ["source"], header=5)


@query("WITH r AS (SELECT p_partkey, p_size, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS running_tokens FROM part) SELECT * FROM r WHERE running_tokens - p_size < 300")
def budget_prefix_inclusive(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return C.within_budget(p, "p_size", 300, [F.desc("p_retailprice"), "p_partkey"], ["p_brand"], include_overflow=True).select("p_partkey", "p_size", "running_tokens")


_PACK = """WITH RECURSIVE c AS (SELECT source, doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f(source, doc_id, cost, i, batch, t, n) AS (SELECT source, doc_id, cost, i, 0::BIGINT, {h} + cost, 1::BIGINT FROM c WHERE i = 1
UNION ALL SELECT c.source, c.doc_id, c.cost, c.i, CASE WHEN {over} THEN batch + 1 ELSE batch END, CASE WHEN {over} THEN {h} + c.cost ELSE t + c.cost END, CASE WHEN {over} THEN 1 ELSE n + 1 END FROM f JOIN c ON c.source = f.source AND c.i = f.i + 1)
SELECT source, doc_id, cost, batch FROM f"""


@query(_PACK.format(h=10, over="t + c.cost > 1500"))
def pack_report_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", T.num_tokens(F.col("text")).alias("cost"))
    return C.pack_batches(docs, ["source"], "doc_id", "cost", 1500, header=10)


@query(_PACK.format(h=0, over="(t + c.cost > 8191 OR n >= 16)"))
def pack_embed_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", T.num_tokens(F.col("text")).alias("cost"))
    return C.pack_batches(docs, ["source"], "doc_id", "cost", 8191, batch_rows=16)


@query(
    """WITH c AS (SELECT l_suppkey, row_number() OVER w AS n, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS cost FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber))
    SELECT l_suppkey, max(n) AS n, max(cost) AS cost FROM c WHERE cost <= 200 GROUP BY l_suppkey"""
)
def longest_fitting_prefix(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    costs = table(spark, d, "lineitem").select("l_suppkey", F.row_number().over(w).cast("long").alias("n"), F.sum(F.col("l_quantity").cast("long")).over(w).alias("cost"))
    return C.longest_fitting_prefix(costs, 200, ["l_suppkey"])


_LIST_PACK = """WITH RECURSIVE c AS (SELECT doc_id, i, ss[i] AS item, CAST(len(regexp_extract_all(ss[i], '\\S+')) AS BIGINT) AS cost FROM (SELECT doc_id, ss, unnest(generate_series(1, len(ss))) AS i
  FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM documents))),
f(doc_id, item, cost, i, chunk_no, t) AS (SELECT doc_id, item, cost, i, 0::BIGINT, 1 + cost FROM c WHERE i = 1
  UNION ALL SELECT c.doc_id, c.item, c.cost, c.i, CASE WHEN t + c.cost > 120 THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN t + c.cost > 120 THEN 1 + c.cost ELSE t + c.cost END FROM f JOIN c ON c.doc_id = f.doc_id AND c.i = f.i + 1)
SELECT doc_id, chunk_no, list(item ORDER BY i) AS items FROM f GROUP BY doc_id, chunk_no"""


@query(_LIST_PACK)
def text_list_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("sentences"))
    return C.pack_lists(docs, ["doc_id"], "sentences", 120)


# -- conversations -----------------------------------------------------------------------------------

_QA = """g AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS qa FROM conversations),
q AS (SELECT conv_id, qa, max(text) FILTER (role = 'user') AS question, arg_min(role, turn) FILTER (role <> 'user') AS role, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'user'), '') AS answer FROM g WHERE qa > 0 GROUP BY conv_id, qa)"""


@query(f"WITH {_QA} SELECT conv_id, qa, question, answer FROM q")
def qa_turns(spark: SparkSession, d: str) -> DataFrame:
    return C.qa_turns(table(spark, d, "conversations"))


@query(f"WITH {_QA} SELECT conv_id, qa, question, answer FROM q")
def qa_turns_stream(spark: SparkSession, d: str) -> DataFrame:
    """The groups of ``qa_turns`` by way of the stream; a turn's number stands for its second of the day."""
    turns = table(spark, d, "conversations").withColumn("ts", F.timestamp_seconds(F.col("turn") + 86_400))
    return replay(turns, f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}").where("not late").select("conv_id", "qa", "question", "answer")


@query("WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations WHERE role = 'user') SELECT * FROM r WHERE nth <= 2")
def user_turns_last_n(spark: SparkSession, d: str) -> DataFrame:
    return C.last_user_turns(table(spark, d, "conversations"), 2).select("conv_id", "turn", "text", "nth")


@query(
    f"""WITH {_QA}, l AS (SELECT conv_id, 'user|' || question || CASE WHEN answer <> '' THEN chr(10) || role || '|' || answer ELSE '' END AS line, row_number() OVER (PARTITION BY conv_id ORDER BY qa DESC) AS nth FROM q),
    b AS (SELECT *, sum(len(regexp_extract_all(line, '\\S+'))) OVER (PARTITION BY conv_id ORDER BY nth) AS run FROM l WHERE nth <= 3)
    SELECT conv_id, string_agg(line, chr(10) ORDER BY nth) AS context FROM b WHERE run <= 120 GROUP BY conv_id"""
)
def history_context(spark: SparkSession, d: str) -> DataFrame:
    return C.history_context(table(spark, d, "conversations"), 3, 120)


@query(
    """WITH e AS (SELECT s_suppkey AS entity, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS entity_order FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10),
    u AS (SELECT DISTINCT l_orderkey AS unit, l_suppkey AS entity FROM lineitem), x AS (SELECT l_orderkey AS unit, l_suppkey AS s, l_partkey % 97 + 1000000 AS t FROM lineitem),
    f AS (SELECT unit, min(entity_order) AS entity_order, arg_min(u.entity, entity_order) AS entity FROM u JOIN e ON u.entity = e.entity GROUP BY unit)
    SELECT f.unit, f.entity_order, count(x.unit) AS num_relationships FROM f LEFT JOIN x ON x.unit = f.unit AND x.s = f.entity GROUP BY ALL"""
)
def text_unit_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    best = table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)
    e = best.select(F.col("s_suppkey").alias("entity"), F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("entity_order"))
    li = table(spark, d, "lineitem")
    u = li.select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("entity"))
    x = li.select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 97 + 1000000).alias("target"))
    return C.text_unit_order(e, u, x)


# -- vectors -----------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE embedding IS NOT NULL)"
_DISTANCES = {
    "cosine": "1 - list_cosine_similarity(q.v, e.v)",
    "l2": "list_distance(q.v, e.v)",
    "l1": "list_sum(list_transform(list_zip(q.v, e.v), lambda x: abs(x[1] - x[2])))",
    "linf": "list_max(list_transform(list_zip(q.v, e.v), lambda x: abs(x[1] - x[2])))",
    "inner": "-list_inner_product(q.v, e.v)",
}


def _knn_sql(metric: str, where: str = "true") -> str:
    return f"""WITH {_E}, s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DISTANCES[metric]} AS distance FROM e q, e WHERE q.vec_id IN (0, 7, 13) AND {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS nth FROM s) SELECT query_id, id, round(distance, 6) AS distance, nth FROM r WHERE nth <= 10"""


def _store(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query(f"WITH {_E}, d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(e.v, q.v) AS x FROM e, e q WHERE q.vec_id % 50 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS INTEGER) AS nth FROM d) SELECT query_id, id, nth, round(x, 6) AS distance FROM r WHERE nth <= 5")
def ivf_nearest(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/ivf-{uuid.uuid4().hex}"
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    ivf.build(rows, folder)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    found = ivf.search(ivf.IvfIndex(spark, folder), asked, 5, f"{folder}/found", exact=True)
    return found.select("query_id", "id", "nth", F.round("distance", 6).alias("distance"))


def _knn(spark: SparkSession, d: str, metric: str, where: str = "true") -> DataFrame:
    store = _store(spark, d)
    q = store.where("id in (0, 7, 13)").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return V.knn(store.where(where), q, 10, metric).select("query_id", "id", F.round("distance", 6).alias("distance"), "nth")


@query(_knn_sql("cosine"))
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "cosine")


@query(_knn_sql("l2"))
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "l2")


@query(_knn_sql("l1"))
def knn_l1(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "l1")


@query(_knn_sql("linf"))
def knn_linf(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "linf")


@query(_knn_sql("inner"))
def knn_inner(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "inner")


@query(_knn_sql("l2", "e.label = 3"))
def knn_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "l2", "label = 3")


@query(f"WITH {_E}, s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DISTANCES['l2']} AS distance FROM e q, e WHERE q.vec_id = 0) SELECT id, round(distance, 6) AS distance FROM s WHERE distance <= 1.2")
def knn_threshold(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d)
    q = store.where("id = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return V.within_threshold(V.distances(store, q, "l2"), 1.2, similarity=True).select("id", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {_E}, s AS (SELECT e.vec_id AS id, list_distance(q.v, e.v) AS dist FROM e q, e WHERE q.vec_id = 5), n AS (SELECT id, row_number() OVER (ORDER BY dist, id) AS o FROM s),
    f AS (SELECT 1 AS g, o, 'e' || id AS title FROM n WHERE o <= 10 AND id NOT IN (5, 20) UNION ALL SELECT 0, CASE WHEN vec_id = 30 THEN 0 ELSE 1 END, 'e' || vec_id FROM e WHERE vec_id IN (30, 10))
    SELECT row_number() OVER (ORDER BY g, o, title) AS place, title FROM f"""
)
def map_query_entities(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d)
    entities = store.select("id", F.concat(F.lit("e"), F.col("id").cast("string")).alias("title"), F.col("label").alias("rank"))
    q = store.where("id = 5").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return V.map_query_entities(store, entities, q, 5, ["e30", "e10"], ["e5", "e20"]).select("place", "title")


_MEAN = "p AS (SELECT {key} AS key, i, sum(x * w) / sum(w) AS m, count(*) AS n FROM (SELECT {key}, unnest(v) AS x, unnest(generate_series(1, len(v))) AS i, {w} AS w FROM e) GROUP BY ALL), m AS (SELECT key, max(n) AS n, list(m ORDER BY i) AS mean FROM p GROUP BY key)"
_ROUND = "list_transform({}, lambda x: round(x, 6))"


def _rounded(name: str):
    return F.transform(name, lambda x: F.round(x, 6) + F.lit(0.0)).alias(name)


@query(f"WITH {_E}, {_MEAN.format(key='label', w='1.0')} SELECT key AS label, {_ROUND.format('CASE WHEN n = 1 THEN mean ELSE list_transform(mean, lambda x: x / sqrt(list_inner_product(mean, mean))) END')} AS embedding FROM m")
def embed_reconstitute(spark: SparkSession, d: str) -> DataFrame:
    return V.reconstitute(_store(spark, d), "label", "vector").select("label", _rounded("embedding"))


@query(f"WITH {_E}, {_MEAN.format(key='label', w='(vec_id % 7 + 1)::DOUBLE')} SELECT key AS label, {_ROUND.format('list_transform(mean, lambda x: x / sqrt(list_inner_product(mean, mean)))')} AS embedding FROM m")
def embed_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    pieces = _store(spark, d).withColumn("n", F.col("id") % 7 + 1)
    return V.weighted_embedding(pieces, "label", "vector", "n").select("label", _rounded("embedding"))


@query(f"WITH {_E}, {_MEAN.format(key='0', w='1.0')} SELECT vec_id AS id, round(list_distance(v, mean), 6) AS distance FROM e, m ORDER BY list_distance(v, mean), vec_id LIMIT 15")
def centroid_sample(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest_to_centroid(_store(spark, d), "id", "vector", 15).select("id", F.round("distance", 6).alias("distance"))


# -- extractor output ----------------------------------------------------------------------------------

_OUT = """x AS (SELECT p_partkey, '("entity"<|>' || p_name || '<|>' || p_brand || '<|> a ' || p_type || ' &amp; part )##("relationship"<|>' || p_name || '<|>' || p_brand || '<|>made by<|>' || p_size || ')##("entity"<|>short)<|COMPLETE|>' AS raw FROM part),
r AS (SELECT p_partkey, i - 1 AS pos, string_split(regexp_replace(regexp_replace(trim(string_split(raw, '##')[i]), '^\\(', ''), '\\)$', ''), '<|>') AS f FROM (SELECT p_partkey, raw, unnest(generate_series(1, len(string_split(raw, '##')))) AS i FROM x))"""


def extractor_output(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    raw = F.concat(
        F.lit('("entity"<|>'), "p_name", F.lit("<|>"), "p_brand", F.lit("<|> a "), "p_type", F.lit(' &amp; part )##("relationship"<|>'), "p_name", F.lit("<|>"), "p_brand",
        F.lit("<|>made by<|>"), F.col("p_size").cast("string"), F.lit(')##("entity"<|>short)<|COMPLETE|>'),
    )
    return p.select("p_partkey", raw.alias("raw"))


@query(f"WITH {_OUT} SELECT p_partkey, pos, upper(f[2]) AS name, upper(f[3]) AS type, replace(trim(f[4]), '&amp;', '&') AS description FROM r WHERE f[1] = '\"entity\"' AND len(f) >= 4")
def parse_entities(spark: SparkSession, d: str) -> DataFrame:
    return T.parse_entities(extractor_output(spark, d), "raw", ["p_partkey"])


@query(f"WITH {_OUT} SELECT p_partkey, pos, upper(f[2]) AS source, upper(f[3]) AS target, f[4] AS description, CAST(f[5] AS DOUBLE) AS weight FROM r WHERE f[1] = '\"relationship\"' AND len(f) >= 5")
def parse_relationships(spark: SparkSession, d: str) -> DataFrame:
    return T.parse_relationships(extractor_output(spark, d), "raw", ["p_partkey"], parse_weight=True)


@query("SELECT o_orderkey, 0 AS pos, 'O' || o_custkey AS subject_id, 'NONE' AS object_id, o_orderpriority AS type, o_orderstatus AS status, NULL::VARCHAR AS start_date, NULL::VARCHAR AS end_date, NULL::VARCHAR AS description, NULL::VARCHAR AS source_text FROM orders")
def parse_claims(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("(O"), F.col("o_custkey").cast("string"), F.lit("<|>NONE<|>"), "o_orderpriority", F.lit("<|> "), "o_orderstatus", F.lit(")##<|COMPLETE|>"))
    return T.parse_claims(table(spark, d, "orders").select("o_orderkey", raw.alias("raw")), "raw", ["o_orderkey"])


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS description, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE CAST(event_id % 100 AS DOUBLE) END AS score FROM events")
def parse_points(spark: SparkSession, d: str) -> DataFrame:
    good = F.concat(F.lit('```json\n{"points": [{"description": "'), "event_type", F.lit('", "score": '), (F.col("event_id") % 100).cast("string"), F.lit("}]}\n```"))
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("no json here")).otherwise(good)
    return T.parse_points(table(spark, d, "events").select("event_id", raw.alias("raw")), "raw", ["event_id"])


# -- providers and search --------------------------------------------------------------------------


@query("SELECT count(DISTINCT lang || '/' || source) FILTER (lang <> 'en') AS asked, count(*) AS rows, count(*) FILTER (lang IS NOT NULL) AS answered FROM documents")
def llm_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("prompt"), "lang")
    known = docs.where("lang = 'en'").select(P.cache_key("text", "chat", F.col("prompt")).alias("key"), F.lit("known").alias("answer")).distinct()
    answers, fresh = P.ask(docs, "prompt", P.StaticProvider(["fine"]), known)
    return answers.agg(F.count("*").alias("rows"), F.count("answer").alias("answered")).select(F.lit(fresh.count()).cast("long").alias("asked"), "rows", "answered")


@query(
    """WITH p AS (SELECT event_id % 50 AS batch, event_type AS description, value AS score, 5 + len(regexp_extract_all(event_type, '\\S+')) AS cost, row_number() OVER (ORDER BY value DESC, event_id % 50, event_type) AS place FROM events WHERE value > 0),
    r AS (SELECT *, sum(cost) OVER (ORDER BY place) AS run FROM p) SELECT batch, description, score FROM r WHERE run <= 2000"""
)
def global_search_reduce(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").select((F.col("event_id") % 50).alias("batch"), F.col("event_type").alias("description"), F.col("value").alias("score"))
    return S.reduce_points(p, 2000).select("batch", "description", "score")


@query()
def global_search(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("community"), F.col("n_name").alias("title"), F.concat_ws(" ", F.lit("about"), "n_name").alias("content"), F.lit(1.0).alias("weight"), F.col("n_regionkey").cast("double").alias("rank"))
    answer = P.StaticProvider(['{"points": [{"description": "a point", "score": 80}, {"description": "none", "score": 0}]}'])
    return S.global_search(n, "what is there?", answer, P.StaticProvider(["an answer"]), 20)


@query()
def local_search_context(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators import graph as G
    from quillgraph.plans.text_graph_queries import supplier_parts

    store = _store(spark, d)
    edges = supplier_parts(spark, d)
    ranked = cut(G.combined_degree(edges, G.node_degree(edges)).withColumn("description", F.concat_ws(" ", F.lit("supplies"), "source", "target")))
    entities = store.select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("title"), F.lit("a part").alias("description"), F.col("label").alias("rank"), "vector", F.col("label").cast("string").alias("community"))
    li = table(spark, d, "lineitem")
    units = li.select(F.col("l_orderkey").alias("unit"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("text"), F.concat(F.lit("p"), (F.col("l_partkey") % 97).cast("string")).alias("entity"))
    reports = entities.select("community").distinct().select("community", F.concat(F.lit("Community "), "community").alias("title"), F.lit("a report").alias("content"))
    q = store.where("id = 3").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return S.local_search_context(entities, ranked, units, reports, q, max_tokens=2000)


# -- trees -------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    leaves = _store(spark, d).select(F.col("id").alias("idx"), F.lit(0).alias("layer"), F.concat_ws(" ", F.lit("leaf"), F.col("id").cast("string")).alias("text"), F.col("vector").cast("array<double>").alias("embedding"), "label")
    parents = V.centroid(leaves, ["label"], "embedding").select((F.lit(1000000) + F.col("label")).cast("long").alias("idx"), F.lit(1).alias("layer"), F.concat_ws(" ", F.lit("parent of label"), F.col("label").cast("string")).alias("text"), F.col("mean").alias("embedding"))
    edges = leaves.select((F.lit(1000000) + F.col("label")).cast("long").alias("parent"), F.col("idx").alias("child"))
    return leaves.drop("label").unionByName(parents), edges


_TREE = f"""{_E}, {_MEAN.format(key='label', w='1.0')}, t AS (SELECT vec_id AS idx, 0 AS layer, v, 2 AS tok FROM e UNION ALL SELECT 1000000 + key, 1, mean, 4 FROM m),
s AS (SELECT t.idx, layer, tok, 1 - list_cosine_similarity(q.v, t.v) AS distance FROM t, e q WHERE q.vec_id = 11)"""


@query(f"WITH {_TREE}, r AS (SELECT *, row_number() OVER (ORDER BY round(distance, 9), idx) AS nth FROM s), b AS (SELECT *, sum(tok) OVER (ORDER BY nth) AS run FROM r WHERE nth <= 20) SELECT nth, idx, round(distance, 6) AS distance, CAST(tok AS BIGINT) AS n_tokens FROM b WHERE run <= 30")
def raptor_collapse_retrieve(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = _tree(spark, d)
    q = _store(spark, d).where("id = 11").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return raptor.collapsed_retrieval(nodes, q, 20, 30).withColumn("distance", F.round("distance", 6))


@query(
    f"""WITH {_TREE}, a AS (SELECT idx, distance FROM s WHERE layer = 1 ORDER BY round(distance, 9), idx LIMIT 3), b AS (SELECT s.idx, s.distance FROM s JOIN e ON s.idx = e.vec_id AND s.layer = 0 WHERE 1000000 + e.label IN (SELECT idx FROM a) ORDER BY round(distance, 9), s.idx LIMIT 3)
    SELECT 1 AS layer, idx, round(distance, 6) AS distance FROM a UNION ALL SELECT 0, idx, round(distance, 6) FROM b"""
)
def raptor_tree_descent(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _tree(spark, d)
    q = _store(spark, d).where("id = 11").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return raptor.tree_descent(nodes, edges, q, 1, 2, 3).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_E}, r AS (SELECT e.vec_id AS idx, list_inner_product(q.v, e.v) AS score FROM e, e q WHERE q.vec_id = 11), n AS (SELECT *, row_number() OVER (ORDER BY round(-score, 9), idx) AS nth FROM r) SELECT nth, idx, round(score, 6) AS score FROM n WHERE nth <= 8 AND (nth - 1) * 2 < 10")
def raptor_flat_retrieve(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = _tree(spark, d)
    q = _store(spark, d).where("id = 11").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return raptor.flat_retrieval(nodes.where("layer = 0"), q, 8, 10).withColumn("score", F.round("score", 6))


@query()
def raptor_gmm_soft(spark: SparkSession, d: str) -> DataFrame:
    return raptor.cluster_nodes(_store(spark, d), "id", "vector", 4)


# -- thoughts ------------------------------------------------------------------------------------------


def _thoughts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = thoughts.thoughts(e, "event_id", F.create_map(F.lit("type"), F.col("event_type"), F.lit("value"), F.col("value").cast("string")))
    return thoughts.score(t, F.col("state")["value"].cast("double"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, value AS score FROM events ORDER BY value DESC, id LIMIT 20")
def got_keep_best(spark: SparkSession, d: str) -> DataFrame:
    return thoughts.keep_best(_thoughts(spark, d), 20).select("id", "score")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type = 'click'")
def got_keep_valid(spark: SparkSession, d: str) -> DataFrame:
    return thoughts.keep_valid(thoughts.validate(_thoughts(spark, d), F.col("state")["type"] == "click")).select("id")


@query("SELECT event_type AS type, arg_max(CAST(event_id AS VARCHAR), (value, CAST(event_id AS VARCHAR))) AS last_id FROM events GROUP BY event_type")
def got_aggregate_state(spark: SparkSession, d: str) -> DataFrame:
    t = _thoughts(spark, d).withColumn("type", F.col("state")["type"]).withColumn("state", F.create_map(F.lit("last"), F.col("id")))
    return thoughts.aggregate(t.select("type", "id", "state", "score"), ["type"]).select("type", F.col("state")["last"].alias("last_id"))


@query("SELECT CAST(event_id AS VARCHAR) || '.' || i AS id, event_type AS type, CAST(i AS VARCHAR) AS part FROM events, (VALUES (0), (1)) p(i)")
def got_generate(spark: SparkSession, d: str) -> DataFrame:
    t = _thoughts(spark, d)
    g = thoughts.generate(t, F.array(*[F.create_map(F.lit("part"), F.lit(str(i))) for i in (0, 1)]))
    return g.select("id", F.col("state")["type"].alias("type"), F.col("state")["part"].alias("part"))


# -- verbs that ask a provider -------------------------------------------------------------------------

_WORDS = "w AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\\b[A-Z][a-z]+'))) AS ns FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_WORDS} SELECT doc_id, upper(n) AS name, 'WORD' AS type, list_sort(list_distinct(list(n || ' is mentioned'))) AS descriptions FROM (SELECT doc_id, unnest(ns) AS n FROM w) GROUP BY doc_id, upper(n)")
def entity_extract(spark: SparkSession, d: str) -> DataFrame:
    return X.entity_extract(table(spark, d, "documents"), "doc_id", "text", P.MentionProvider())[0]


@query(
    f"""WITH {_WORDS}, p AS (SELECT doc_id, upper(ns[i]) AS a, upper(ns[i + 1]) AS b, ns[i] || ' stands before ' || ns[i + 1] AS x FROM (SELECT doc_id, ns, unnest(generate_series(1, len(ns) - 1)) AS i FROM w))
    SELECT doc_id, least(a, b) AS source, greatest(a, b) AS target, list_sort(list_distinct(list(x))) AS descriptions, CAST(2 * count(*) AS DOUBLE) AS weight FROM p GROUP BY ALL"""
)
def relationship_extract(spark: SparkSession, d: str) -> DataFrame:
    return X.entity_extract(table(spark, d, "documents"), "doc_id", "text", P.MentionProvider())[1]


@query(f"WITH {_WORDS} SELECT doc_id, n AS subject_id, n || ' is mentioned' AS description, i - 1 AS pos, 'claim' AS covariate_type FROM (SELECT doc_id, unnest(ns) AS n, unnest(generate_series(1, len(ns))) AS i FROM w)")
def extract_covariates(spark: SparkSession, d: str) -> DataFrame:
    claims = X.extract_covariates(table(spark, d, "documents"), "doc_id", "text", P.MentionProvider(claims=True))
    return claims.select("doc_id", "subject_id", "description", F.col("pos").cast("long").alias("pos"), "covariate_type")


@query("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN max(c_mktsegment) ELSE 'a summary' END AS summary FROM customer GROUP BY c_nationkey")
def summarize_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return X.summarize_descriptions(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", P.StaticProvider(["a summary"]))


_PIECES = """WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS tk FROM documents), p AS (SELECT doc_id, tk[s + 1 : s + 40] AS part FROM (SELECT doc_id, tk, unnest(generate_series(0, len(tk) - 1, 40)) AS s FROM t WHERE len(tk) > 0)),
v AS (SELECT doc_id, CAST(len(part) AS DOUBLE) AS a, CAST(length(array_to_string(part, ' ')) AS DOUBLE) AS b FROM p), m AS (SELECT doc_id, count(*) AS n, avg(a) AS a, avg(b) AS b FROM v GROUP BY doc_id)"""


@query(_PIECES + " SELECT doc_id, CASE WHEN n = 1 THEN [a, b] ELSE [round(a / sqrt(a * a + b * b), 9), round(b / sqrt(a * a + b * b), 9)] END AS embedding FROM m")
def text_embed(spark: SparkSession, d: str) -> DataFrame:
    measure = lambda c: F.array(T.num_tokens(c).cast("double"), F.length(c).cast("double"))
    made, _ = X.text_embed(table(spark, d, "documents"), "doc_id", "text", measure, 40)
    return made.select("doc_id", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))


@query("SELECT c_custkey AS id, c_name AS title, [c_mktsegment] AS tags, NULL::BIGINT AS rank FROM customer")
def typed_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("tags"))
    return X.typed(rows, {"id": "long", "title": "string"}, {"tags": "array<string>", "rank": "long"})


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (12, 305)")
def entity_by_key(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "customer").withColumn("key", F.regexp_replace(F.col("c_custkey").cast("string"), "(.)(?=.)", "$1-"))
    return X.by_key(keyed, "key", ["12", "3-05", "9-9-9-9-9-9"]).select("c_custkey", "c_name")


@query("SELECT lang, 2 * avg(quality) * avg(toxic) / nullif(avg(quality) + avg(toxic), 0) AS f FROM (SELECT lang, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM labels JOIN documents USING (doc_id)) GROUP BY lang")
def harmonic_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    means = rows.groupBy("lang").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    return means.select("lang", F.try_divide(2 * F.col("q") * F.col("t"), F.col("q") + F.col("t")).alias("f"))


@query(f"WITH d AS (SELECT DISTINCT source, lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) SELECT lang, count(*) AS calls, CAST(2 * count(*) AS BIGINT) AS prompt_tokens, CAST(count(*) AS BIGINT) AS answer_tokens FROM d GROUP BY lang")
def token_accounting(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang is not null and source is not null").select("lang", F.concat_ws(" ", F.lit("about"), F.concat_ws("/", "source", "lang")).alias("prompt"))
    answers, _ = P.ask(docs, "prompt", P.StaticProvider(["fine"]))
    return X.token_account(answers, "prompt", "answer", ["lang"])


@query(f"WITH {_E}, q AS (SELECT v FROM e WHERE vec_id = 8), n AS (SELECT e.vec_id, label, list_distance(q.v, e.v) AS distance, row_number() OVER (ORDER BY list_distance(q.v, e.v), e.vec_id) AS o FROM e, q) SELECT 'e' || vec_id AS title, label AS rank, round(distance, 6) AS distance FROM n WHERE o <= 12 AND vec_id NOT IN (8, 9) ORDER BY label DESC, 'e' || vec_id LIMIT 6")
def neighbors_by_embedding(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators import graph as G

    name = F.concat(F.lit("e"), F.col("id").cast("string"))
    store = _store(spark, d)
    found = G.neighbors_by_embedding(store.select(name.alias("title"), F.col("label").alias("rank")), store.select(name.alias("node"), F.col("vector").alias("embedding")), "e8", 6, ["e9"])
    return found.withColumn("distance", F.round("distance", 6))


@query("SELECT l_suppkey, l_partkey, l_suppkey % 9 = 0 AS in_context FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def in_context_flags(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    chosen = table(spark, d, "supplier").where("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return C.flag_in_context(pairs, chosen, "l_suppkey")


@query("SELECT o_custkey, c_name FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey")
def entities_of_edges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_custkey").alias("target"))
    return C.touched_by(o, table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("o_custkey"), "c_name")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 15")
def tuning_texts(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators.tuning import choose_texts

    return choose_texts(table(spark, d, "documents").select("doc_id"), "doc_id")
