"""Queries of the relational and text verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.session import table
from quillgraph.operators import relational as R
from quillgraph.operators.relational import VerbInput
from quillgraph.plans.registry import query


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def verb_select(spark: SparkSession, d: str) -> DataFrame:
    return R.select(VerbInput(table(spark, d, "orders")), ["o_orderkey", "o_totalprice", "o_orderpriority"])


@query("SELECT c_custkey AS id, c_name AS title, c_nationkey FROM customer")
def verb_rename_drop(spark: SparkSession, d: str) -> DataFrame:
    kept = R.drop(VerbInput(table(spark, d, "customer")), ["c_acctbal", "c_mktsegment"])
    return R.rename(VerbInput(kept), {"c_custkey": "id", "c_name": "title"})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * l_quantity AS volume FROM lineitem")
def verb_derive(spark: SparkSession, d: str) -> DataFrame:
    return R.derive(VerbInput(table(spark, d, "lineitem")), "volume", "l_extendedprice", "*", "l_quantity").select("l_orderkey", "l_linenumber", "volume")


@query("SELECT n_nationkey, n_name, 'nation' AS kind, n_name AS label FROM nation")
def verb_fill_copy(spark: SparkSession, d: str) -> DataFrame:
    filled = R.fill(VerbInput(table(spark, d, "nation").select("n_nationkey", "n_name")), "kind", "nation")
    return R.copy(VerbInput(filled), "n_name", "label")


@query("SELECT p_partkey, try_cast(p_brand AS BIGINT) AS p_brand, CAST(p_size AS VARCHAR) AS p_size, string_split(p_type, ' ') AS p_type FROM part")
def verb_convert(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    out = R.convert(VerbInput(part), ["p_brand"], "integer")
    out = R.convert(VerbInput(out), ["p_size"], "str")
    return R.convert(VerbInput(out), ["p_type"], "array", " ")


@query("SELECT c_custkey, concat(c_name, '/', c_mktsegment) AS label FROM customer")
def verb_merge_concat(spark: SparkSession, d: str) -> DataFrame:
    return R.merge(VerbInput(table(spark, d, "customer")), ["c_name", "c_mktsegment"], "label", delimiter="/").select("c_custkey", "label")


@query("SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderpriority")
def verb_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return R.dedupe(VerbInput(table(spark, d, "orders").select("o_orderpriority", "o_orderkey")), ["o_orderpriority"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def verb_orderby_topk(spark: SparkSession, d: str) -> DataFrame:
    ordered = R.orderby(VerbInput(table(spark, d, "orders").select("o_orderkey", "o_totalprice")), [{"column": "o_totalprice", "direction": "desc"}, {"column": "o_orderkey"}])
    return ordered.limit(25)


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 50")
def verb_sample_md5(spark: SparkSession, d: str) -> DataFrame:
    return R.sample(VerbInput(table(spark, d, "customer").select("c_custkey", "c_name")), 50, "c_custkey", 7)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR l_quantity > 49")
def filter_value(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a = R.filter_rows(VerbInput(li), "l_returnflag", [{"operator": "equals", "value": "R"}]).select("l_orderkey", "l_linenumber")
    b = li.where(R.predicate(li, "l_quantity", "is greater than", 49) & ~R.predicate(li, "l_returnflag", "equals", "R")).select("l_orderkey", "l_linenumber")
    return R.concat(VerbInput(a, [b]))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = l_tax")
def filter_column(spark: SparkSession, d: str) -> DataFrame:
    return R.filter_rows(VerbInput(table(spark, d, "lineitem")), "l_discount", [{"type": "column", "operator": "equals", "value": "l_tax"}]).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> ''")
def filter_not_empty(spark: SparkSession, d: str) -> DataFrame:
    return R.filter_rows(VerbInput(table(spark, d, "documents")), "text", [{"operator": "is not empty"}]).select("doc_id")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def unroll_split(spark: SparkSession, d: str) -> DataFrame:
    split = table(spark, d, "part").select("p_partkey", T.split_text(F.col("p_name"), " ").alias("words"))
    return R.unroll(VerbInput(split), "words", "word")


@query("SELECT p_partkey, CASE WHEN p_name = '' THEN [] ELSE string_split(p_name, ' ') END AS words FROM part")
def verb_text_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.split_text(F.col("p_name"), " ").alias("words"))


@query("SELECT doc_id, replace(replace(text, 'the', '*'), 'and', '&') AS text FROM documents")
def verb_text_replace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.replace_all(F.col("text"), [("the", "*"), ("and", "&")]).alias("text"))


@query(
    "SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(trim(html), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[\\x00-\\x1f\\x{7f}-\\x{9f}]', '', 'g') AS html FROM pages"
)
def verb_clean_str(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.clean_str(F.col("html")).alias("html"))


@query("SELECT c_custkey, c_name AS zip_name, c_nationkey AS zip_nation FROM customer")
def verb_zip_unzip(spark: SparkSession, d: str) -> DataFrame:
    zipped = R.zip_columns(VerbInput(table(spark, d, "customer")), ["c_name", "c_nationkey"], "z")
    return R.unzip(VerbInput(zipped), "z", ["zip_name", "zip_nation"]).select("c_custkey", "zip_name", "zip_nation")


@query("SELECT c_custkey, c_name AS v_name, c_mktsegment AS v_segment FROM customer")
def verb_zip_dict(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("k", F.array(F.lit("name"), F.lit("segment"))).withColumn("v", F.array("c_name", "c_mktsegment"))
    z = R.zip_columns(VerbInput(c), ["k", "v"], "m", "dict")
    return z.select("c_custkey", F.col("m")["name"].alias("v_name"), F.col("m")["segment"].alias("v_segment"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def verb_spread_json(spark: SparkSession, d: str) -> DataFrame:
    return R.spread_json(VerbInput(table(spark, d, "events")), "props", "k long", ["event_id"])


@query("SELECT doc_id, md5(concat(doc_id, text)) AS id FROM documents")
def genid_md5(spark: SparkSession, d: str) -> DataFrame:
    return R.genid(VerbInput(table(spark, d, "documents")), "id", hash=["doc_id", "text"]).select("doc_id", "id")


@query("SELECT n_name, row_number() OVER (ORDER BY n_name) AS id FROM nation")
def genid_increment(spark: SparkSession, d: str) -> DataFrame:
    return R.genid(VerbInput(table(spark, d, "nation").select("n_name")), "id", "increment", order=["n_name"])


@query("SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS human_readable_id FROM customer")
def human_readable_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.enumerate_rows(table(spark, d, "customer").select("c_name"), "human_readable_id", ["c_name"])


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS orders, list_sort(list_distinct(list(o_orderpriority))) AS priorities, min(o_orderstatus) AS any_status FROM orders GROUP BY o_custkey")
def agg_arrays(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(
        VerbInput(table(spark, d, "orders")),
        [{"column": "o_orderkey", "operation": "array_agg", "to": "orders"}, {"column": "o_orderpriority", "operation": "array_agg_distinct", "to": "priorities"}, {"column": "o_orderstatus", "operation": "any", "to": "any_status"}],
        ["o_custkey"],
    )


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_string_concat(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(VerbInput(table(spark, d, "nation")), [{"column": "n_name", "operation": "string_concat", "to": "names", "separator": ";"}], ["n_regionkey"])


@query(
    """SELECT p_brand, sum(p_size)::BIGINT AS a_sum, min(p_size) AS a_min, max(p_size) AS a_max, round(avg(p_size), 6) AS a_mean, median(p_size) AS a_median, count(*) AS a_count,
    count(DISTINCT p_size) AS a_distinct, count(p_size) AS a_valid, count(*) FILTER (p_size IS NULL) AS a_invalid, round(stddev_samp(p_size), 6) AS a_stdev,
    round(stddev_pop(p_size), 6) AS a_stdevp, round(var_samp(p_size), 6) AS a_variance FROM part GROUP BY p_brand"""
)
def agg_numeric_all(spark: SparkSession, d: str) -> DataFrame:
    ops = ["sum", "min", "max", "mean", "median", "count", "distinct", "valid", "invalid", "stdev", "stdevp", "variance"]
    out = R.aggregate(VerbInput(table(spark, d, "part")), [{"column": "p_size", "operation": o, "to": f"a_{o}"} for o in ops], ["p_brand"])
    return out.withColumns({f"a_{o}": F.round(f"a_{o}", 6) for o in ("mean", "stdev", "stdevp", "variance")})


@query("WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, arg_min(l_linenumber, (-n, l_linenumber)) AS top_line FROM c GROUP BY l_returnflag")
def agg_mode(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(VerbInput(table(spark, d, "lineitem")), [{"column": "l_linenumber", "operation": "mode", "to": "top_line"}], ["l_returnflag"])


@query("SELECT n_regionkey, product(n_nationkey + 1) AS p FROM nation GROUP BY n_regionkey")
def agg_product(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("k", F.col("n_nationkey") + 1)
    return R.aggregate_one(VerbInput(n), "k", "product", "p", "n_regionkey")


@query("SELECT n_name, r_name, n_regionkey, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    return R.join(VerbInput(table(spark, d, "nation"), [table(spark, d, "region")]), ["n_regionkey", "r_regionkey"]).select("n_name", "r_name", "n_regionkey", "r_regionkey")


@query("SELECT a.n_regionkey, a.n_name AS n_name_1, b.n_name AS n_name_2, a.n_nationkey AS n_nationkey_1, b.n_nationkey AS n_nationkey_2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_inner_suffix(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return R.join(VerbInput(n, [n]), ["n_regionkey"])


@query("SELECT c_custkey, c_name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    j = R.join(VerbInput(table(spark, d, "customer").select("c_custkey", "c_name"), [table(spark, d, "orders").select("o_custkey", "o_orderkey")]), ["c_custkey", "o_custkey"], "left", null_safe=False)
    return j.groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT d.doc_id, l.quality FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
def join_right_docs(spark: SparkSession, d: str) -> DataFrame:
    return R.join(VerbInput(table(spark, d, "labels").select("doc_id", "quality"), [table(spark, d, "documents").select("doc_id")]), ["doc_id"], "right")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return R.anti_join(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    return R.semi_join(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'O'"), "c_custkey", "o_custkey")


@query("SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def concat_rows(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return R.concat(VerbInput(a, [b]))


@query("SELECT c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def concat_missing_cols(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return R.concat(VerbInput(a, [table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))]))


@query("WITH a AS (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM region), b AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation) SELECT r_name, n_name FROM a FULL JOIN b USING (i)")
def concat_columns(spark: SparkSession, d: str) -> DataFrame:
    return R.concat(VerbInput(table(spark, d, "region").select("r_name"), [table(spark, d, "nation").select("n_name")]), column_wise=True)


@query("SELECT DISTINCT n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return R.union(VerbInput(table(spark, d, "customer").select(F.col("c_nationkey").alias("n")), [table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"))]))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return R.intersect(VerbInput(o.where("o_orderstatus = 'F'").select("k"), [o.where("o_orderstatus = 'O'").select("k")]))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return R.difference(VerbInput(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), [table(spark, d, "orders").select(F.col("o_custkey").alias("k"))]))


@query(
    """SELECT o_custkey, o_orderkey, rank() OVER w AS r, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, first_value(o_orderstatus) OVER f AS fv, last_value(o_orderstatus) OVER f AS lv
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), f AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def window_functions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    for name, op in (("r", "rank"), ("pr", "percent_rank"), ("cd", "cume_dist"), ("fv", "first_value"), ("lv", "last_value")):
        t = R.window(VerbInput(t), op, name, "o_orderstatus", ["o_orderkey"], ["o_custkey"])
    return t.withColumns({"pr": F.round("pr", 6), "cd": F.round("cd", 6)}).drop("o_orderstatus")


@query(
    """WITH v AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS x FROM events)
    SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS down,
    first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up FROM v"""
)
def window_fill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("x"))
    t = R.window(VerbInput(e), "fill_down", "down", "x", ["event_id"], ["user_id"])
    return R.window(VerbInput(t), "fill_up", "up", "x", ["event_id"], ["user_id"]).select("event_id", "down", "up")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY o_orderpriority")
def verb_pivot(spark: SparkSession, d: str) -> DataFrame:
    return R.pivot(VerbInput(table(spark, d, "orders")), "o_orderstatus", "o_orderkey", "count", ["F", "O"], ["o_orderpriority"]).na.fill(0)


@query("SELECT l_orderkey, l_linenumber, unnest(['l_discount', 'l_tax']) AS key, unnest([l_discount, l_tax]) AS value FROM lineitem")
def verb_fold(spark: SparkSession, d: str) -> DataFrame:
    return R.fold(VerbInput(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")), ["l_discount", "l_tax"])


@query(
    """SELECT p_partkey, floor((p_size - 0.0) / 10) * 10 + 0.0 AS bin, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS large, CASE WHEN p_brand = 'Brand#11' THEN 'first' ELSE p_brand END AS brand,
    CASE WHEN p_size = 1 THEN NULL ELSE p_size END AS erased FROM part"""
)
def verb_bin_recode(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    t = R.bin_values(VerbInput(t), "p_size", "bin", 10)
    t = R.binarize(VerbInput(t), "p_size", "large", "is greater than", 25)
    t = R.recode(VerbInput(t), "p_brand", "brand", {"Brand#11": "first"})
    return R.erase(VerbInput(t.withColumn("erased", F.col("p_size"))), "erased", [1]).select("p_partkey", "bin", "large", "brand", "erased")


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 9) AS scaled, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS s_BUILDING FROM customer")
def verb_normalize_onehot(spark: SparkSession, d: str) -> DataFrame:
    t = R.normalize(VerbInput(table(spark, d, "customer")), "c_acctbal", "scaled")
    return R.onehot(VerbInput(t), "c_mktsegment", ["BUILDING"], "s_").select("c_custkey", F.round("scaled", 9).alias("scaled"), "s_BUILDING")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def verb_lookup(spark: SparkSession, d: str) -> DataFrame:
    return R.lookup(VerbInput(table(spark, d, "customer"), [table(spark, d, "nation")]), ["c_nationkey", "n_nationkey"], ["n_name"]).select("c_custkey", "n_name")


@query("SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[3] AS w3 FROM part")
def verb_strings_spread(spark: SparkSession, d: str) -> DataFrame:
    t = R.strings(VerbInput(table(spark, d, "part").select("p_partkey", "p_name")), "p_name", "up", "upper")
    t = R.strings(VerbInput(t), "p_name", "len", "length")
    return R.spread(VerbInput(t), "p_name", ["w1", "w2", "w3"], " ").select("p_partkey", "up", "len", "w1", "w3")
