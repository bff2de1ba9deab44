"""Queries of text windows, extraction, graphs and communities over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.bpe import BpeTokens
from quillgraph.functions.session import cut, table
from quillgraph.operators import context as C
from quillgraph.operators import graph as G
from quillgraph.operators import raptor
from quillgraph.plans.registry import query

CHUNK, OVERLAP = 50, 10

_WINDOWS = """tk AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS tk FROM documents),
chunks AS (SELECT doc_id, s // {step} AS chunk_no, tk[s + 1 : s + {size}] AS part FROM (SELECT doc_id, tk, unnest(generate_series(0, len(tk) - 1, {step})) AS s FROM tk WHERE len(tk) > 0))"""


def windows_sql(size: int, overlap: int) -> str:
    return _WINDOWS.format(size=size, step=size - overlap)


MENTIONS_SQL = windows_sql(CHUNK, OVERLAP) + """,
found AS (SELECT doc_id, chunk_no, regexp_extract_all(array_to_string(part, ' '), '\\b[A-Z][a-z]+') AS names FROM chunks),
mentions AS (SELECT doc_id, chunk_no, unnest(names) AS name, unnest(generate_series(0, len(names) - 1)) AS pos FROM found WHERE len(names) > 0)"""
PAIRS_SQL = MENTIONS_SQL + """,
pairs AS (SELECT a.doc_id, a.chunk_no, least(a.name, b.name) AS source, greatest(a.name, b.name) AS target FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.chunk_no = b.chunk_no AND a.pos < b.pos)"""
#: Supplier-part pairs of lineitem as a weighted graph.
SP_SQL = "sp AS (SELECT 's' || l_suppkey AS source, 'p' || (l_partkey % 97) AS target, CAST(sum(l_quantity) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL)"


def chunks(spark: SparkSession, d: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    return T.token_windows(table(spark, d, "documents"), ["doc_id"], "text", "doc_id", size, overlap)


def named_chunks(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, chunk_no, names): the capitalised words of each window, in order."""
    return chunks(spark, d).select("doc_id", "chunk_no", F.regexp_extract_all("chunk", F.lit(T.ENTITY), F.lit(0)).alias("names"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return named_chunks(spark, d).select("doc_id", "chunk_no", F.posexplode("names").alias("pos", "name"))


def mention_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, chunk_no, source, target, n): the pairs of each window and how often it has them."""
    return G.pair_counts(named_chunks(spark, d), ["doc_id", "chunk_no"], "names")


def supplier_parts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    rows = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), (F.col("l_partkey") % 97).cast("string")).alias("target"), F.col("l_quantity").cast("double").alias("q"))
    return rows.groupBy("source", "target").agg(F.sum("q").alias("weight"))


@query(
    f"WITH {PAIRS_SQL}, edges AS (SELECT source, target, count(*) AS weight FROM pairs WHERE source <> target GROUP BY ALL), "
    "deg AS (SELECT t, count(*) AS degree FROM (SELECT source AS t FROM edges UNION ALL SELECT target FROM edges) GROUP BY t) "
    "SELECT e.source, e.target, e.weight, a.degree + b.degree AS rank FROM edges e JOIN deg a ON e.source = a.t JOIN deg b ON e.target = b.t ORDER BY rank DESC, weight DESC, source, target LIMIT 20"
)
def top_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: documents to windows to mentions to pairs to degrees to the best relationships."""
    edges = cut(mention_pairs(spark, d).where("source <> target").groupBy("source", "target").agg(F.sum("n").alias("weight")))
    ranked = G.combined_degree(edges, G.node_degree(edges)).select("source", "target", "weight", "rank")
    return ranked.orderBy(F.desc("rank"), F.desc("weight"), "source", "target").limit(20)


@query(f"WITH {windows_sql(300, 100)} SELECT doc_id, chunk_no, array_to_string(part, ' ') AS chunk, len(part) AS n_tokens, [CAST(doc_id AS VARCHAR)] AS document_ids FROM chunks")
def doc_chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, 300, 100)


@query(
    """WITH t AS (SELECT doc_id // 8 AS grp, doc_id, regexp_extract_all(text, '\\S+') AS tk FROM documents),
    u AS (SELECT grp, doc_id, unnest(tk) AS w, unnest(generate_series(1, len(tk))) AS i FROM t WHERE len(tk) > 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, i) - 1 AS p, count(*) OVER (PARTITION BY grp) AS total FROM u),
    s AS (SELECT grp, unnest(generate_series(0, max(total) - 1, 200)) AS st FROM n GROUP BY grp)
    SELECT n.grp, CAST(s.st // 200 AS BIGINT) AS chunk_no, md5(string_agg(w, ' ' ORDER BY p)) AS chunk_md5, count(*) AS n_tokens, list_sort(list(DISTINCT doc_id)) AS document_ids
    FROM n JOIN s ON n.grp = s.grp AND p >= st AND p < st + 300 GROUP BY n.grp, s.st"""
)
def chunk_grouped_multi_doc(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("grp", F.floor(F.col("doc_id") / 8).cast("long"))
    out = T.token_windows(docs, ["grp"], "text", "doc_id", 300, 100)
    return out.select("grp", "chunk_no", F.md5("chunk").alias("chunk_md5"), "n_tokens", F.array_sort(F.transform("document_ids", lambda x: x.cast("long"))).alias("document_ids"))


@query()
def bpe_token_count(spark: SparkSession, d: str) -> DataFrame:
    """Byte-pair tokens, words and documents of every source."""
    docs = table(spark, d, "documents").withColumn("tokens", BpeTokens(spark).num_tokens("text"))
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum(T.num_tokens(F.col("text"))).alias("words"), F.count("*").alias("docs"))


@query()
def bpe_chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 300 byte-pair tokens, 100 of them shared, over every document."""
    return BpeTokens(spark).windows(table(spark, d, "documents"), ["doc_id"], "text", "doc_id", 300, 100)


@query()
def bpe_chunk_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Windows of byte-pair tokens over the joined documents of every language."""
    return BpeTokens(spark).windows(table(spark, d, "documents"), ["lang"], "text", "doc_id", 1200, 100)


@query("SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '') AS sentences FROM documents")
def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("sentences"))


@query("SELECT sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS tokens, count(*) AS docs FROM documents")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.sum(T.num_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("docs"))


@query(
    """WITH RECURSIVE q AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?\\n]'), lambda x: regexp_replace(x, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')), lambda x: x <> '') AS ss FROM documents),
    s AS (SELECT doc_id, i, ss[i] AS t, len(regexp_extract_all(ss[i], '\\S+')) AS n FROM (SELECT doc_id, ss, unnest(generate_series(1, len(ss))) AS i FROM q)),
    l AS (SELECT doc_id, i, list_filter(list_transform(regexp_split_to_array(t, '[,;:]'), lambda x: regexp_replace(x, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')), lambda x: x <> '') AS ps FROM s WHERE n > 100),
    u AS (SELECT doc_id, i, j, ps[j] AS t, true AS apart FROM (SELECT doc_id, i, ps, unnest(generate_series(1, len(ps))) AS j FROM l) UNION ALL SELECT doc_id, i, 1, t, false FROM s WHERE n <= 100),
    p AS (SELECT doc_id, i, apart, t, len(regexp_extract_all(t, '\\S+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM u),
    f(doc_id, k, i, apart, nth, size) AS (SELECT doc_id, k, i, apart, 0::BIGINT, n FROM p WHERE k = 1
      UNION ALL SELECT p.doc_id, p.k, p.i, p.apart, CASE WHEN ((f.apart OR p.apart) AND f.i <> p.i) OR f.size + p.n > 100 THEN f.nth + 1 ELSE f.nth END,
        CASE WHEN ((f.apart OR p.apart) AND f.i <> p.i) OR f.size + p.n > 100 THEN p.n ELSE f.size + p.n END FROM f JOIN p ON p.doc_id = f.doc_id AND p.k = f.k + 1),
    c AS (SELECT doc_id, nth, string_agg(t, ' ' ORDER BY k) AS chunk FROM f JOIN p USING (doc_id, k) GROUP BY ALL)
    SELECT doc_id, nth, chunk, CAST(len(regexp_extract_all(chunk, '\\S+')) AS BIGINT) AS n_tokens FROM c"""
)
def raptor_split(spark: SparkSession, d: str) -> DataFrame:
    return raptor.split_texts(table(spark, d, "documents"), "doc_id", "text", 100)


@query(f"WITH {PAIRS_SQL} SELECT source, target, count(*) AS weight, count(DISTINCT doc_id) AS docs FROM pairs GROUP BY ALL")
def extract_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    per = mention_pairs(spark, d).groupBy("source", "target", "doc_id").agg(F.sum("n").alias("n"))
    return per.groupBy("source", "target").agg(F.sum("n").alias("weight"), F.count("*").alias("docs"))


_NODE_FOLDS = ("replace", "skip", "sum", "average", "max", "min", "multiply")


@query(
    """WITH v AS (SELECT 'p' || l_partkey AS title, l_orderkey * 10 + l_linenumber AS ord, l_quantity AS q, l_linenumber AS m, l_shipdate AS s, l_returnflag AS f FROM lineitem)
    SELECT title, CAST(arg_max(f, ord) AS VARCHAR) AS v_replace, CAST(arg_min(f, ord) AS VARCHAR) AS v_skip, CAST(sum(q) AS DOUBLE) AS v_sum, round(avg(q), 6) AS v_average, CAST(max(q) AS DOUBLE) AS v_max,
    CAST(min(q) AS DOUBLE) AS v_min, round(ln(product(CAST(m AS DOUBLE))), 6) AS v_multiply, CASE WHEN count(*) = 1 THEN max(f) ELSE array_to_string(list_sort(list_distinct(list(f))), ',') END AS v_concat FROM v GROUP BY title"""
)
def merge_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    v = li.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("title"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.col("l_returnflag").alias("v_replace"), F.col("l_returnflag").alias("v_skip"), *[F.col("l_quantity").alias(f"v_{o}") for o in ("sum", "average", "max", "min")],
        F.col("l_linenumber").alias("v_multiply"), F.col("l_returnflag").alias("v_concat"),
    )
    out = G.merge_graph(v, ["title"], "ord", {f"v_{o}": o for o in _NODE_FOLDS} | {"v_concat": {"operation": "concat", "distinct": True}})
    return out.withColumn("v_average", F.round("v_average", 6)).withColumn("v_multiply", F.round(F.ln("v_multiply"), 6))


@query(f"WITH {SP_SQL} SELECT source, target, weight FROM sp")
def merge_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), (F.col("l_partkey") % 97).cast("string")).alias("target"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_quantity").alias("weight"),
    )
    return G.merge_graph(li, ["source", "target"], "ord", {"*": "replace", "weight": "sum"})


_DEG = "deg AS (SELECT t AS title, count(*) AS degree FROM (SELECT source AS t FROM sp UNION ALL SELECT target FROM sp) GROUP BY t)"


@query(f"WITH {SP_SQL}, {_DEG} SELECT title, degree FROM deg")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.node_degree(supplier_parts(spark, d))


@query(f"WITH {SP_SQL}, {_DEG} SELECT source, target, weight, a.degree AS source_degree, b.degree AS target_degree, a.degree + b.degree AS rank FROM sp JOIN deg a ON source = a.title JOIN deg b ON target = b.title")
def edge_combined_degree(spark: SparkSession, d: str) -> DataFrame:
    edges = supplier_parts(spark, d)
    return G.combined_degree(edges, G.node_degree(edges))


#: A sparse graph: every order hangs on its customer, and seven customers are a chain. Orders are numbered below customers.
SPARSE_SQL = """sparse AS (SELECT DISTINCT -o_orderkey AS source, o_custkey AS target FROM orders
  UNION SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey < (SELECT max(c_custkey) FROM customer))"""
_CC = f"""WITH RECURSIVE {SPARSE_SQL}, n AS (SELECT source AS a, target AS b FROM sparse UNION SELECT target, source FROM sparse),
r(node, lab) AS (SELECT a, a FROM n UNION SELECT n.b, r.lab FROM r JOIN n ON r.node = n.a), cc AS (SELECT node, min(lab) AS component FROM r GROUP BY node)"""


def sparse_graph(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select((-F.col("o_orderkey")).alias("source"), F.col("o_custkey").alias("target"))
    c = table(spark, d, "customer").select("c_custkey")
    last = F.broadcast(c.agg(F.max("c_custkey").alias("last")))  # a single row
    chain = c.where("c_custkey % 7 <> 0").join(last, F.col("c_custkey") < F.col("last")).select(F.col("c_custkey").alias("source"), (F.col("c_custkey") + 1).alias("target"))
    return orders.unionByName(chain).distinct()


@query(f"{_CC} SELECT node, component FROM cc")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(sparse_graph(spark, d))


@query(f"{_CC}, best AS (SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT source, target FROM sparse WHERE source IN (SELECT node FROM cc WHERE component IN (FROM best))")
def largest_component(spark: SparkSession, d: str) -> DataFrame:
    return G.largest_component(cut(sparse_graph(spark, d)))


@query()
def community_detect(spark: SparkSession, d: str) -> DataFrame:
    return G.hierarchical_communities(cut(sparse_graph(spark, d)), weight=None, use_lcc=False)


@query()
def node2vec(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all nodes, with the reference's figures: 10 walks of 40 nodes each, a window of 2, 3 iterations, 1536 numbers."""
    return G.node_embeddings(cut(sparse_graph(spark, d)), dimensions=1536, num_walks=10, walk_length=40, window=2, iterations=3, seed=86)


@query(
    f"WITH {SP_SQL}, {_DEG}, nodes AS (SELECT title, degree FROM deg) SELECT title, degree, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, '-1' AS cluster, degree AS size FROM nodes"
)
def layout_zero(spark: SparkSession, d: str) -> DataFrame:
    return G.layout_zero(G.node_degree(supplier_parts(spark, d)))


@query(f"WITH {SP_SQL}, {_DEG} SELECT title, md5(title) AS id, row_number() OVER (ORDER BY title) - 1 AS human_readable_id FROM deg")
def graph_node_ids(spark: SparkSession, d: str) -> DataFrame:
    edges = supplier_parts(spark, d)
    return G.number_graph(G.node_degree(edges).select("title"), edges)[0]


@query("SELECT 'c' || c_custkey AS title FROM customer")
def graphml_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    nodes = G.create_nodes(c.withColumn("t", F.concat(F.lit("c"), F.col("c_custkey").cast("string"))), "t")
    edges = G.create_edges(c.withColumn("t", F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).withColumn("n", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))), "t", "n")
    cell = G.to_graphml(nodes, edges).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "key", "line"))), lambda x: x["line"]), "").alias("g"))
    return G.from_graphml(cell, "g")[0]


# -- nested levels: region, nation, nation x segment over customers --------------------------------

LEVELS_SQL = """nodes AS (SELECT 0 AS level, 'r' || n_regionkey AS community, 'c' || c_custkey AS title, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 1, 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer UNION ALL SELECT 2, 'n' || c_nationkey || c_mktsegment, 'c' || c_custkey, c_custkey FROM customer)"""
CEDGE_SQL = """ce AS (SELECT DISTINCT 'c' || least(a, b) AS source, 'c' || greatest(a, b) AS target FROM (SELECT o_custkey AS a, (o_custkey * 7 + 3) % 1500 + 1 AS b FROM orders) WHERE a <> b),
cedges AS (SELECT source || '-' || target AS id, source, target FROM ce)"""


def level_nodes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    title = F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("title")
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    level = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("community")),
        F.struct(F.lit(1).alias("level"), nation.alias("community")), F.struct(F.lit(2).alias("level"), F.concat(nation, "c_mktsegment").alias("community")),
    ))
    return c.select(level.alias("l"), title, "c_custkey").select("l.level", "l.community", "title", "c_custkey")


def customer_edges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + 3) % 1500 + 1).alias("b")).where("a <> b")
    end = lambda c: F.concat(F.lit("c"), c.cast("string"))
    e = o.select(end(F.least("a", "b")).alias("source"), end(F.greatest("a", "b")).alias("target")).distinct()
    return e.withColumn("id", F.concat_ws("-", "source", "target"))


@query(
    f"WITH {LEVELS_SQL}, {CEDGE_SQL}, j AS (SELECT n.level, n.community, n.title, e.id FROM nodes n JOIN cedges e ON n.title = e.source OR n.title = e.target) "
    "SELECT level, community, 'Community ' || community AS title, list_sort(list(DISTINCT id)) AS relationship_ids, list_sort(list(DISTINCT title)) AS text_unit_ids FROM j GROUP BY level, community"
)
def final_communities(spark: SparkSession, d: str) -> DataFrame:
    n = level_nodes(spark, d).select("level", "community", "title", F.col("title").alias("source_id"))
    e = customer_edges(spark, d).withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return G.final_communities(n, e)


@query(
    f"WITH {LEVELS_SQL}, s AS (SELECT level, community, list(DISTINCT title) AS m FROM nodes GROUP BY ALL) "
    "SELECT a.level, a.community, b.level AS sub_level, b.community AS sub_community, len(b.m) AS sub_size FROM s a JOIN s b ON b.level = a.level + 1 AND list_has_all(a.m, b.m)"
)
def community_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return G.community_hierarchy(level_nodes(spark, d))


@query(
    f"WITH {LEVELS_SQL}, u AS (SELECT community, count(DISTINCT o_orderkey) AS units FROM nodes JOIN orders ON c_custkey = o_custkey WHERE level = 1 GROUP BY community) SELECT community, units, round(units / max(units) OVER (), 9) AS weight FROM u"
)
def community_weights(spark: SparkSession, d: str) -> DataFrame:
    m = level_nodes(spark, d).where("level = 1").select(F.col("title").alias("entity"), "community")
    u = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity"), F.col("o_orderkey").alias("unit"))
    return C.community_weights(m, u).withColumn("weight", F.round("weight", 9))


@query(f"WITH {LEVELS_SQL} SELECT community, count(DISTINCT title) AS matches FROM nodes WHERE level = 2 AND c_custkey % 10 = 0 GROUP BY community")
def community_matches(spark: SparkSession, d: str) -> DataFrame:
    n = level_nodes(spark, d).where("level = 2")
    return C.community_matches(n.select(F.col("title").alias("entity"), "community"), n.where("c_custkey % 10 = 0").select(F.col("title").alias("entity")))


@query(
    f"WITH {LEVELS_SQL}, {CEDGE_SQL}, m AS (SELECT title, max(CAST(regexp_extract(community, '^n([0-9]+)$', 1) AS INTEGER)) AS c FROM nodes WHERE level <= 1 AND regexp_matches(community, '^n[0-9]+$') GROUP BY title) "
    "SELECT title AS name, 1 AS rank, CAST(c AS VARCHAR) AS community, md5(title) AS id FROM m"
)
def indexer_entities(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators.search import indexer_entities as adapt

    n = level_nodes(spark, d).withColumn("degree", F.lit(1)).withColumn("community", F.regexp_replace("community", "^n", ""))
    e = n.select(F.col("title").alias("name"), F.md5("title").alias("id")).distinct()
    return adapt(n, e, 1)


@query(f"WITH {LEVELS_SQL}, c AS (SELECT DISTINCT level, replace(community, 'n', '') AS community FROM nodes WHERE level = 1) SELECT level, community, 'report ' || community AS full_content FROM c")
def indexer_reports(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators.search import indexer_reports as adapt

    n = level_nodes(spark, d).withColumn("community", F.regexp_replace("community", "^n", "")).withColumn("degree", F.lit(1))
    reports = n.select("level", "community").distinct().withColumn("full_content", F.concat(F.lit("report "), "community"))
    return adapt(n, reports, 1)


def _contexts(spark: SparkSession, d: str, budget: int) -> DataFrame:
    nodes = level_nodes(spark, d).withColumn("human_readable_id", F.col("c_custkey")).withColumn("description", F.concat_ws(" ", F.lit("customer"), "title"))
    e = customer_edges(spark, d)
    a = nodes.select(F.col("level").alias("la"), F.col("community").alias("ca"), F.col("title").alias("ta"))
    b = nodes.select(F.col("level").alias("lb"), F.col("community").alias("cb"), F.col("title").alias("tb"))
    inner = e.join(a, F.col("source") == F.col("ta")).join(b, (F.col("target") == F.col("tb")) & (F.col("la") == F.col("lb")) & (F.col("ca") == F.col("cb")))
    inner = inner.select(F.col("la").alias("level"), F.col("ca").alias("community"), "source", "target", F.col("id").alias("human_readable_id"), F.length("id").alias("rank"), F.concat_ws(" ", F.lit("edge"), "source", "target").alias("description"))
    return C.sorted_context(inner, nodes, budget)


@query(
    f"""WITH {LEVELS_SQL}, {CEDGE_SQL}, i AS (SELECT a.level, a.community, e.source, e.target, e.id, length(e.id) AS rank, row_number() OVER (PARTITION BY a.level, a.community ORDER BY length(e.id) DESC, e.id) AS nth
      FROM cedges e JOIN nodes a ON e.source = a.title JOIN nodes b ON e.target = b.title AND a.level = b.level AND a.community = b.community),
    f AS (SELECT level, community, t, min(nth) AS nth FROM (SELECT level, community, source AS t, nth FROM i UNION ALL SELECT level, community, target, nth FROM i) GROUP BY ALL),
    k AS (SELECT i.*, 3 + 2 * (SELECT count(*) FROM f WHERE f.level = i.level AND f.community = i.community AND f.nth = i.nth) AS cost FROM i),
    r AS (SELECT *, sum(cost) OVER (PARTITION BY level, community ORDER BY nth) AS run, sum(cost) OVER (PARTITION BY level, community) AS total FROM k)
    SELECT level, community, CAST(max(total) AS BIGINT) AS context_size, count(*) FILTER (run <= 60) AS n_edges, max(total) > 60 AS exceeds FROM r GROUP BY level, community"""
)
def report_context_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d, 60).select("level", "community", "context_size", "n_edges", "exceeds")


@query()
def report_local_context(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d, 60)


@query()
def report_prep_substitution(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.functions.providers import StaticProvider
    from quillgraph.operators.extraction import community_reports

    contexts = cut(_contexts(spark, d, 60))
    hierarchy = cut(G.community_hierarchy(level_nodes(spark, d)))
    return community_reports(contexts, hierarchy, (2, 1, 0), StaticProvider(["a report", "a second report"]), 60)[0]


# -- selections -----------------------------------------------------------------------------------

_SEL = "sel AS (SELECT 's' || s_suppkey AS title FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL SELECT 'p' || x FROM range(0, 97, 5) t(x))"


def selected(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").where("s_suppkey % 9 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("title"))
    return s.unionByName(spark.range(0, 97, 5).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("title")))


@query(f"WITH {SP_SQL}, {_SEL} SELECT source, target, weight FROM sp WHERE source IN (FROM sel) AND target IN (FROM sel)")
def rel_in_network(spark: SparkSession, d: str) -> DataFrame:
    return G.in_network(supplier_parts(spark, d), selected(spark, d))


@query(f"WITH {SP_SQL}, {_SEL} SELECT source, target, weight FROM sp WHERE (source IN (FROM sel)) <> (target IN (FROM sel))")
def rel_out_network(spark: SparkSession, d: str) -> DataFrame:
    return G.out_network(supplier_parts(spark, d), selected(spark, d))


@query(f"WITH {SP_SQL}, {_SEL} SELECT source, target, weight FROM sp WHERE source IN (FROM sel) OR target IN (FROM sel)")
def rel_candidates(spark: SparkSession, d: str) -> DataFrame:
    return G.candidate_edges(supplier_parts(spark, d), selected(spark, d))


@query(
    f"""WITH {SP_SQL}, {_SEL}, i AS (SELECT source, target, weight FROM sp WHERE source IN (FROM sel) AND target IN (FROM sel)),
    o AS (SELECT *, CASE WHEN source IN (FROM sel) THEN target ELSE source END AS x, CASE WHEN source IN (FROM sel) THEN source ELSE target END AS y FROM sp WHERE (source IN (FROM sel)) <> (target IN (FROM sel))),
    l AS (SELECT x, count(DISTINCT y) AS links FROM o GROUP BY x), b AS (SELECT source, target, weight, links FROM o JOIN l USING (x) ORDER BY links DESC, weight DESC, source, target LIMIT (SELECT 2 * count(*) FROM sel))
    SELECT source, target, weight, true AS in_network, NULL::BIGINT AS links FROM i UNION ALL SELECT source, target, weight, false, links FROM b"""
)
def rel_filter_topk(spark: SparkSession, d: str) -> DataFrame:
    return G.filter_relationships(supplier_parts(spark, d), selected(spark, d), 2, "weight")


@query(f"WITH {SP_SQL}, {_DEG} SELECT title, degree FROM deg WHERE title IN (SELECT target FROM sp WHERE source = 's5') AND title <> 'p7' ORDER BY degree DESC, title LIMIT 10")
def neighbors_by_rank(spark: SparkSession, d: str) -> DataFrame:
    edges = supplier_parts(spark, d)
    return G.neighbors_by_rank(edges, G.node_degree(edges), "s5", 10, ["p7"])


# -- index tables ----------------------------------------------------------------------------------


@query(f"WITH {windows_sql(300, 100)} SELECT CAST(d.doc_id AS VARCHAR) AS id, any_value(source) AS title, any_value(text) AS raw_content, coalesce(list(md5(d.doc_id || '-' || chunk_no) ORDER BY chunk_no) FILTER (chunk_no IS NOT NULL), []) AS text_unit_ids FROM documents d LEFT JOIN chunks c ON d.doc_id = c.doc_id GROUP BY d.doc_id")
def base_documents(spark: SparkSession, d: str) -> DataFrame:
    ids = chunks(spark, d, 300, 100).select(F.col("doc_id").alias("k"), "chunk_no").groupBy("k").agg(F.array_sort(F.collect_list("chunk_no")).alias("nos"))
    docs = table(spark, d, "documents").join(ids, F.col("doc_id") == F.col("k"), "left")
    unit = F.transform(F.coalesce("nos", F.array().cast("array<long>")), lambda n: F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), n.cast("string"))))
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("raw_content"), unit.alias("text_unit_ids"))


@query(f"WITH {MENTIONS_SQL} SELECT md5(doc_id || '-' || chunk_no) AS id, list_sort(list(DISTINCT md5(name))) AS entity_ids FROM mentions GROUP BY doc_id, chunk_no")
def text_units_to_entities(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_set(F.md5("name"))).alias("entity_ids")).select(F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string"))).alias("id"), "entity_ids")


@query(f"WITH {PAIRS_SQL} SELECT md5(doc_id || '-' || chunk_no) AS id, list_sort(list(DISTINCT md5(source || '->' || target))) AS relationship_ids FROM pairs GROUP BY doc_id, chunk_no")
def text_units_to_relationships(spark: SparkSession, d: str) -> DataFrame:
    g = mention_pairs(spark, d).groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_set(F.md5(F.concat("source", F.lit("->"), "target")))).alias("relationship_ids"))
    return g.select(F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string"))).alias("id"), "relationship_ids")


@query(
    f"""WITH {PAIRS_SQL}, e AS (SELECT doc_id, chunk_no, count(DISTINCT name) AS n_entities FROM mentions GROUP BY ALL), r AS (SELECT doc_id, chunk_no, count(DISTINCT (source, target)) AS n_relationships FROM pairs GROUP BY ALL)
    SELECT md5(c.doc_id || '-' || c.chunk_no) AS id, array_to_string(part, ' ') AS text, len(part) AS n_tokens, [CAST(c.doc_id AS VARCHAR)] AS document_ids, coalesce(n_entities, 0) AS n_entities, coalesce(n_relationships, 0) AS n_relationships
    FROM chunks c LEFT JOIN e ON c.doc_id = e.doc_id AND c.chunk_no = e.chunk_no LEFT JOIN r ON c.doc_id = r.doc_id AND c.chunk_no = r.chunk_no"""
)
def final_text_units(spark: SparkSession, d: str) -> DataFrame:
    unit = F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string"))).alias("id")
    names = F.regexp_extract_all("chunk", F.lit(T.ENTITY), F.lit(0))
    c = chunks(spark, d).select(unit, F.col("chunk").alias("text"), "n_tokens", "document_ids", names.alias("_names"))
    # Pairs of distinct names, and of a name with itself where a window has it twice.
    n = F.size(F.array_distinct("_names")).cast("long")
    twice = F.size(F.array_distinct(F.filter("_names", lambda x, i: F.array_position(F.col("_names"), x) <= i))).cast("long")
    pairs = F.floor(n * (n - 1) / 2).cast("long") + twice
    return c.select("id", "text", "n_tokens", "document_ids", n.alias("n_entities"), pairs.alias("n_relationships"))


@query(
    f"""WITH {PAIRS_SQL}, units AS (SELECT doc_id, chunk_no, md5(doc_id || '-' || chunk_no) AS id FROM chunks)
    SELECT 'document' AS src_type, CAST(doc_id AS VARCHAR) AS src, 'HAS' AS relation, 'text_unit' AS dst_type, id AS dst FROM units
    UNION SELECT 'text_unit', md5(doc_id || '-' || chunk_no), 'MENTIONS', 'entity', md5(name) FROM mentions
    UNION SELECT 'text_unit', md5(doc_id || '-' || chunk_no), 'STATES', 'relationship', md5(source || '->' || target) FROM pairs
    UNION SELECT 'relationship', md5(source || '->' || target), 'CONNECTS', 'entity', md5(x) FROM (SELECT source, target, unnest([source, target]) AS x FROM pairs)"""
)
def graph_sink_edges(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.sources.files import index_graph

    unit = F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")))
    held = cut(named_chunks(spark, d).select("doc_id", unit.alias("id"), "names"))
    docs = held.groupBy("doc_id").agg(F.collect_set("id").alias("text_unit_ids")).withColumnRenamed("doc_id", "id")
    # A unit's pairs are made in its row, twice, rather than stored and grouped by unit again.
    p = G.pair_lists(held, ["id", "names"], "names")
    named = lambda x: F.md5(F.concat(x["source"], F.lit("->"), x["target"]))
    units = p.where(F.size("names") > 0).select("id", F.transform(F.array_distinct("names"), F.md5).alias("entity_ids"), F.transform("pairs", named).alias("relationship_ids"))
    entities = held.select(F.explode("names").alias("name")).distinct().select(F.md5("name").alias("id"), "name")
    rel = p.select(F.explode("pairs").alias("p")).select("p.source", "p.target").distinct().select(named({"source": F.col("source"), "target": F.col("target")}).alias("id"), "source", "target")
    return index_graph(docs, units, entities, rel)
