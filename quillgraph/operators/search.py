"""Local and global search over index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.providers import Answer, ask
from quillgraph.operators import context as C
from quillgraph.operators import graph as G
from quillgraph.operators import vectors as V

NO_DATA = "No report holds anything that answers this question."


def local_search_context(entities: DataFrame, edges: DataFrame, units: DataFrame, reports: DataFrame, query: DataFrame | None, k: int = 10, top_k_relationships: int = 10, max_tokens: int = 12000, community_prop: float = 0.1, text_unit_prop: float = 0.5) -> DataFrame:
    """(section_no, section, context, n_rows): the context tables of a local search.

    ``entities`` is (id, title, description, rank, vector, community), ``edges`` (source, target,
    description, weight, rank), ``units`` (unit, text, entity), ``reports`` (community, title, content).
    """
    if community_prop + text_unit_prop > 1:
        raise ValueError("the shares of communities and text units exceed 1")
    found = V.map_query_entities(entities.select("id", "vector"), entities.select("id", "title", "rank"), query, k).select(F.col("title").alias("_t"), "place")
    chosen = entities.join(found, F.col("title") == F.col("_t")).drop("_t")
    matches = C.community_matches(chosen.select(F.col("title").alias("entity"), "community").where("community is not null"), chosen.select(F.col("title").alias("entity")))
    r = reports.join(matches.select(F.col("community").alias("_c"), "matches"), F.col("community") == F.col("_c"))
    sections = [(1, C.table_context(r, ["community", "title", "content"], [F.desc("matches"), "community"], int(max_tokens * community_prop), "Reports"))]
    local = int(max_tokens * (1 - community_prop - text_unit_prop))
    sections.append((2, C.table_context(chosen, ["id", "title", "description", "rank"], ["place"], local, "Entities")))
    kept = G.filter_relationships(edges.select("source", "target", "description", "weight", "rank"), chosen.select("title"), top_k_relationships)
    sections.append((3, C.table_context(kept, ["source", "target", "description", "weight", "rank"], [F.desc("in_network"), F.desc("links"), F.desc("rank"), "source", "target"], local, "Relationships")))
    first = units.join(chosen.select(F.col("title").alias("_e"), "place"), F.col("entity") == F.col("_e")).groupBy("unit").agg(F.min("place").alias("place"), F.min("text").alias("text"))
    sections.append((4, C.table_context(first, ["unit", "text"], ["place", "unit"], int(max_tokens * text_unit_prop), "Sources")))
    out = None
    for no, s in sections:
        s = s.select(F.lit(no).alias("section_no"), "section", "context", "n_rows")
        out = s if out is None else out.unionByName(s)
    return out


def report_batches(reports: DataFrame, max_tokens: int, seed: int = 86, shuffle: bool = True) -> DataFrame:
    """(batch, community, title, content, weight, rank): reports in seeded order, packed by tokens."""
    order = F.md5(F.concat(F.lit(str(seed)), F.col("community").cast("string"))) if shuffle else F.lpad(F.col("community").cast("string"), 20, "0")
    r = reports.withColumn("_o", order).withColumn("cost", T.num_tokens(F.concat_ws("|", "title", "content")))
    packed = C.pack_batches(r, [], ["_o", "title", "content"], "cost", max_tokens)
    return packed.select("batch", "community", "title", "content", "weight", "rank")


def global_search(reports: DataFrame, question: str, map_provider: Answer, reduce_provider: Answer, max_tokens: int = 12000) -> DataFrame:
    """(answer): reports in batches, one answer of scored points each, the best points as one answer."""
    batches = report_batches(reports, max_tokens)
    lines = batches.withColumn("line", F.concat_ws("|", "community", "title", "content"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.coalesce("weight", F.lit(0.0))).alias("w"), (-F.coalesce("rank", F.lit(0.0))).alias("r"), "line")))
    prompts = lines.groupBy("batch").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("table"))
    prompts = prompts.withColumn("prompt", T.fill_template("{table}\n\nQuestion: {question}", {"table": F.col("table"), "question": F.lit(question)}))
    answers, _ = ask(prompts, "prompt", map_provider, name="map")
    points = T.parse_points(answers, "answer", ["batch"])
    text = reduce_points(points, max_tokens).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n\n").alias("text"), F.count("*").alias("n"))
    prompt = text.withColumn("prompt", T.fill_template("{text}\n\nQuestion: {question}", {"text": F.col("text"), "question": F.lit(question)}))
    final, _ = ask(prompt.where("n > 0"), "prompt", reduce_provider, name="reduce")
    return final.select("answer").unionByName(prompt.where("n = 0").select(F.lit(NO_DATA).alias("answer")))


def reduce_points(points: DataFrame, max_tokens: int) -> DataFrame:
    """(place, batch, description, score, line): points of positive score, best first, within the budget."""
    order = [F.desc("score"), "batch", "description"]
    p = points.where("score > 0").withColumn("line", F.concat(F.lit("----Analyst "), (F.col("batch") + 1).cast("string"), F.lit("----\nImportance Score: "), F.col("score").cast("string"), F.lit("\n"), F.col("description")))
    # Every line costs a token or more: what may fit is a top-k, not a sort of all points.
    p = p.withColumn("cost", T.num_tokens(F.col("line"))).orderBy(*order).limit(min(max_tokens + 1, 1 << 30)).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return C.within_budget(p, "cost", max_tokens, ["place"]).select("place", "batch", "description", "score", "line")


def question_candidates(answers: DataFrame, answer: str) -> DataFrame:
    """(nth, question): non-empty lines of generated questions."""
    lines = answers.select(F.posexplode(F.split(F.col(answer), "\n")).alias("nth", "question"))
    return lines.select("nth", F.trim(F.regexp_replace("question", r"^\s*[-*]\s*", "")).alias("question")).where("question <> ''")


def indexer_entities(nodes: DataFrame, entities: DataFrame, level: int) -> DataFrame:
    """(name, rank, community, id) of entities at levels up to ``level``: the deepest community by number."""
    n = nodes.where(F.col("level") <= level).select("title", F.col("degree").alias("rank"), F.coalesce(F.col("community").try_cast("int"), F.lit(-1)).alias("c"))
    n = n.groupBy("title", "rank").agg(F.max("c").cast("string").alias("community"))
    first = Window.partitionBy("name").orderBy("id", "rank")
    e = entities.select(F.col("name"), "id").join(n, F.col("name") == F.col("title"))
    return e.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("name", "rank", "community", "id")


def indexer_reports(nodes: DataFrame, reports: DataFrame, level: int) -> DataFrame:
    """Reports at levels up to ``level`` whose community is the deepest of some node."""
    n = nodes.where(F.col("level") <= level).select("title", F.coalesce(F.col("community").try_cast("int"), F.lit(-1)).alias("c"))
    keep = n.groupBy("title").agg(F.max("c").alias("c")).select(F.col("c").cast("string").alias("_k")).distinct()
    return reports.where(F.col("level") <= level).join(keep, F.col("community").cast("string") == F.col("_k"), "left_semi")
