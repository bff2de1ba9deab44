"""Token budgets, batches, conversations, and the context tables of search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.session import cut
from quillgraph.functions.text import num_tokens
from quillgraph.operators.packing import BLOCK_ROWS, pack_in_blocks, pack_in_stream


#: Selected entities that are broadcast; more are joined by a shuffle.
FEW_ENTITIES = 10_000


def within_budget(df: DataFrame, cost: str, budget: int, order: Sequence, partition: Sequence[str] = (), header: int = 0, include_overflow: bool = False) -> DataFrame:
    """Rows in order while ``header`` and their running cost stay within ``budget``.

    Costs are not negative, so stopping at the first overflow keeps exactly these rows.
    ``include_overflow`` also keeps the row that overflows.
    """
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("running_tokens", F.sum(cost).over(w) + F.lit(header))
    used = F.col("running_tokens") - (F.col(cost) if include_overflow else 0)
    return out.where(used <= budget if not include_overflow else used < budget)


def pack_batches(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], cost: str, budget: int, header: int = 0, batch_rows: int | None = None) -> DataFrame:
    """``df`` with ``batch``: in order, a new batch starts where a row would overflow the current one.

    A row above the budget has a batch of its own; a null cost is 0. Where a batch starts depends on all
    rows before it: groups of up to BLOCK_ROWS rows are read as sorted streams, one task a group, and
    if some group is larger, all are cut into blocks whose starts are found side by side.
    """
    order = [order] if isinstance(order, str) else list(order)
    rows = cut(df)
    largest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    way = pack_in_blocks if largest > BLOCK_ROWS else pack_in_stream
    return way(rows, keys, order, cost, budget, header, batch_rows)


def pack_lists(df: DataFrame, keys: Sequence[str], items: str, max_tokens: int) -> DataFrame:
    """(keys, chunk_no, items): a list cut into runs whose text as a JSON list stays within ``max_tokens``.

    The brackets cost one token; an item above the budget is a run of its own. An empty list has none.
    """
    rows = df.select(*keys, F.posexplode(items).alias("_pos", "item")).withColumn("_cost", num_tokens(F.col("item")))
    packed = pack_batches(rows, keys, "_pos", "_cost", max_tokens, header=1)
    run = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "item"))), lambda x: x["item"])
    return packed.groupBy(*keys, F.col("batch").alias("chunk_no")).agg(run.alias("items"))


# -- conversations -------------------------------------------------------------------------------


def qa_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", with_role: bool = False) -> DataFrame:
    """(conv, qa, question, answer): a user turn opens a group, the turns up to the next one answer it.

    ``with_role`` adds ``role``, that of the first answering turn.
    """
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = turns.withColumn("qa", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).where("qa > 0")
    answers = F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.struct(F.col(turn).alias("t"), F.col("text").alias("x")))))
    role = [F.min_by(F.when(F.col("role") != "user", F.col("role")), F.when(F.col("role") != "user", F.col(turn))).alias("role")] if with_role else []
    return g.groupBy(conv, "qa").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"), F.array_join(F.transform(answers, lambda a: a["x"]), "\n").alias("answer"), *role)


def last_user_turns(turns: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``n`` user turns of each conversation, latest first (nth = 1 is the latest)."""
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    return turns.where("role = 'user'").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def history_context(turns: DataFrame, max_turns: int, budget: int, recency_bias: bool = True, include_answers: bool = True) -> DataFrame:
    """(conv_id, context): question and answer groups within turns and tokens, latest first if biased."""
    qa = qa_turns(turns, with_role=True)
    line = F.concat(F.lit("user|"), F.col("question"))
    if include_answers:
        line = F.concat(line, F.when(F.col("answer") != "", F.concat(F.lit("\n"), F.col("role"), F.lit("|"), F.col("answer"))).otherwise(F.lit("")))
    qa = qa.withColumn("line", line).withColumn("cost", num_tokens(F.col("line")))
    order = F.desc("qa") if recency_bias else F.asc("qa")
    qa = qa.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(order))).where(F.col("nth") <= max_turns)
    kept = within_budget(qa, "cost", budget, ["nth"], ["conv_id"])
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("context"))


# -- entity, relationship, text unit and report contexts -----------------------------------------


def context_line(columns: Sequence[str]) -> Column:
    """Values joined by a bar; null is empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def table_context(df: DataFrame, columns: Sequence[str], order: Sequence, budget: int, name: str) -> DataFrame:
    """One row (section, context, n_rows): a header and the rows within the budget, in order."""
    header = "|".join(columns)
    rows = df.withColumn("_line", context_line(columns)).withColumn("_cost", num_tokens(F.col("_line")))
    if len(columns) > 1:  # every line holds a bar, so a token: what may fit is a top-k, not a sort of all rows
        rows = rows.orderBy(*order).limit(max(0, min(budget + 1, 1 << 30)))
    kept = within_budget(rows, "_cost", budget, order, header=len(header.split()))
    kept = kept.withColumn("_nth", F.row_number().over(Window.orderBy(*order)))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_line"))), lambda x: x["_line"]), "\n")
    return kept.agg(lines.alias("_lines"), F.count("*").alias("n_rows")).select(F.lit(name).alias("section"), F.concat(F.lit(f"-----{name}-----\n{header}\n"), F.col("_lines")).alias("context"), "n_rows")


def flag_in_context(candidates: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """``candidates`` with ``in_context``: whether a row's key is among the chosen ones."""
    c = chosen.select(F.col(key).alias("_k")).distinct()
    return candidates.join(c, F.col(key) == F.col("_k"), "left").withColumn("in_context", F.col("_k").isNotNull()).drop("_k")


def levels_of(reports: DataFrame, level: str = "level") -> DataFrame:
    """(level): the distinct levels, the deepest first, without null."""
    return reports.where(F.col(level).isNotNull()).select(level).distinct().orderBy(F.desc(level))


def touched_by(edges: DataFrame, rows: DataFrame, title: str) -> DataFrame:
    """Rows whose title is an end of some edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("_end")).distinct()
    return rows.join(ends, F.col(title) == F.col("_end"), "left_semi")


def holding_ids(rows: DataFrame, ids: str, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose array of ids holds some wanted id."""
    w = wanted.select(F.col(key).alias("_w")).distinct()
    own = rows.withColumn("_row", F.xxhash64(F.to_json(F.struct(*rows.columns))))
    hit = own.select("_row", F.explode(ids).alias("_i")).join(w, F.col("_i") == F.col("_w"), "left_semi").select(F.col("_row").alias("_h")).distinct()
    return own.join(hit, F.col("_row") == F.col("_h"), "left_semi").drop("_row")


def community_weights(memberships: DataFrame, units: DataFrame) -> DataFrame:
    """(community, units, weight): distinct text units of a community's entities over the largest such number.

    ``memberships`` is (entity, community), ``units`` (entity, unit).
    """
    u = units.select(F.col("entity").alias("_e"), "unit")
    n = memberships.join(u, F.col("entity") == F.col("_e")).groupBy("community").agg(F.count_distinct("unit").alias("units"))
    n = cut(n)
    most = n.agg(F.max("units").alias("_most"))  # a single row
    return n.join(F.broadcast(most)).select("community", "units", F.try_divide(F.col("units"), F.col("_most")).alias("weight"))


def community_matches(memberships: DataFrame, selected: DataFrame) -> DataFrame:
    """(community, matches): how many selected entities a community has."""
    s = selected.select(F.col("entity").alias("_e")).distinct()
    return memberships.join(s, F.col("entity") == F.col("_e"), "left_semi").groupBy("community").agg(F.count_distinct("entity").alias("matches"))


def text_unit_order(entities: DataFrame, unit_entities: DataFrame, unit_edges: DataFrame) -> DataFrame:
    """(unit, entity_order, num_relationships) of units that a selected entity mentions.

    ``entities`` is (entity, entity_order), ``unit_entities`` (unit, entity), ``unit_edges`` (unit,
    source, target). A unit belongs to its first entity; its number of relationships is that of its
    edges which touch that entity. Read it ordered by entity_order and falling num_relationships.
    """
    e = cut(entities.select(F.col("entity").alias("_e"), "entity_order"))
    near = F.broadcast if e.count() <= FEW_ENTITIES else lambda x: x
    first = unit_entities.join(near(e), F.col("entity") == F.col("_e")).groupBy("unit").agg(F.min(F.struct("entity_order", "entity")).alias("m")).select("unit", "m.*")
    ends = unit_edges.select(F.col("unit").alias("_u"), F.explode(F.array_distinct(F.array("source", "target"))).alias("_t"))
    # A unit's entity is a selected one, so only ends at these are counted.
    ends = ends.join(near(e.select(F.col("_e").alias("_s")).distinct()), F.col("_t") == F.col("_s"), "left_semi")
    n = ends.groupBy("_u", "_t").agg(F.count("*").alias("num_relationships"))
    return first.join(n, (F.col("unit") == F.col("_u")) & (F.col("entity") == F.col("_t")), "left").select("unit", "entity_order", F.coalesce("num_relationships", F.lit(0)).alias("num_relationships"))


def longest_fitting_prefix(costs: DataFrame, budget: int, keys: Sequence[str] = ()) -> DataFrame:
    """The longest prefix before the first overflow of (keys, n, cost), costs recomputed for every prefix."""
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = costs.withColumn("_worst", F.max("cost").over(w)).where(F.col("_worst") <= budget)
    return fits.groupBy(*keys).agg(F.max(F.struct("n", "cost")).alias("_m")).where("_m is not null").select(*keys, "_m.n", "_m.cost")


# -- community reports ---------------------------------------------------------------------------


def local_contexts(nodes: DataFrame, edges: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(level, community, title, degree, details, edge_details, claim_details), one row per member.

    ``nodes`` is (level, community, title, degree, human_readable_id, description), ``edges`` (source,
    target, human_readable_id, rank, description). A member brings the edges it ends.
    """
    n = nodes.where("community is not null").select("level", "community", "title", "degree", F.struct("human_readable_id", "title", F.coalesce("description", F.lit("No Description")).alias("description"), "degree").alias("details"))
    detail = F.struct("human_readable_id", "source", "target", F.coalesce("description", F.lit("No Description")).alias("description"), "rank")
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("_end"), detail.alias("_edge"))
    grouped = n.join(ends, F.col("title") == F.col("_end"), "left").groupBy("level", "community", "title", "degree").agg(F.first("details").alias("details"), F.array_sort(F.collect_set("_edge")).alias("edge_details"))
    if claims is None:
        return grouped.withColumn("claim_details", F.array().cast("array<struct<subject_id:string,description:string>>"))
    c = claims.groupBy(F.col("subject_id").alias("_s")).agg(F.array_sort(F.collect_set(F.struct("subject_id", "description"))).alias("claim_details"))
    return grouped.join(c, F.col("title") == F.col("_s"), "left").drop("_s")


def sorted_context(edges: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """(level, community, context, context_size, n_edges, exceeds): edges by rank within the budget.

    ``edges`` is (level, community, source, target, human_readable_id, rank, description) of inner
    edges, ``nodes`` (level, community, title, human_readable_id, description). The context has the
    entities of the kept edges, then the edges; an edge is kept while the edges and their ends fit.
    """
    e = edges.withColumn("_line", F.concat_ws(",", "human_readable_id", "source", "target", "description", "rank")).withColumn("_cost", num_tokens(F.col("_line")))
    w = Window.partitionBy("level", "community").orderBy(F.desc("rank"), "human_readable_id")
    e = e.withColumn("_nth", F.row_number().over(w))
    n = nodes.select(F.col("level").alias("_l"), F.col("community").alias("_c"), F.col("title").alias("_t"), F.concat_ws(",", F.col("human_readable_id").cast("string"), "title", "description").alias("_nline"))
    ends = e.select("level", "community", "_nth", F.explode(F.array_distinct(F.array("source", "target"))).alias("_end"))
    first = ends.groupBy("level", "community", "_end").agg(F.min("_nth").alias("_nth")).join(n, (F.col("level") == F.col("_l")) & (F.col("community") == F.col("_c")) & (F.col("_end") == F.col("_t")), "left")
    per = first.groupBy(F.col("level").alias("_l2"), F.col("community").alias("_c2"), F.col("_nth").alias("_n2")).agg(
        F.sum(num_tokens(F.coalesce("_nline", F.lit("")))).alias("_ncost"), F.array_sort(F.collect_list("_nline")).alias("_nlines")
    )
    both = e.join(per, (F.col("level") == F.col("_l2")) & (F.col("community") == F.col("_c2")) & (F.col("_nth") == F.col("_n2")), "left")
    both = both.withColumn("_all", F.col("_cost") + F.coalesce("_ncost", F.lit(0)))
    total = both.groupBy(F.col("level").alias("_lt"), F.col("community").alias("_ct")).agg(F.sum("_all").alias("context_size"))
    kept = within_budget(both, "_all", budget, ["_nth"], ["level", "community"])
    lines = kept.groupBy("level", "community").agg(
        F.array_sort(F.collect_list(F.struct("_nth", "_line", "_nlines"))).alias("_k"), F.count("*").alias("n_edges")
    )
    names = F.array_join(F.flatten(F.transform("_k", lambda x: F.coalesce(x["_nlines"], F.array().cast("array<string>")))), "\n")
    text = F.concat(F.lit("-----Entities-----\n"), names, F.lit("\n\n-----Relationships-----\n"), F.array_join(F.transform("_k", lambda x: x["_line"]), "\n"))
    out = total.join(lines.withColumn("_text", text), (F.col("level") == F.col("_lt")) & (F.col("community") == F.col("_ct")), "left")
    return out.select(F.col("_lt").alias("level"), F.col("_ct").alias("community"), F.coalesce("_text", F.lit("")).alias("context"), "context_size", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), (F.col("context_size") > budget).alias("exceeds"))


def mixed_context(subs: DataFrame, budget: int) -> DataFrame:
    """(community, mixed): sub-communities' reports in place of their raw contexts until all fits.

    ``subs`` is (community, sub_community, report, context, context_size). Sub-contexts go largest
    first; the first i whose reports, with the others' raw contexts, fit the budget wins; if none
    does, the longest run of reports that fits. A sub-community without a report keeps its context.
    """
    s = subs.withColumn("_r", num_tokens(F.col("report")))
    by = Window.partitionBy("community").orderBy(F.desc("context_size"), "sub_community")
    s = s.withColumn("_i", F.row_number().over(by))
    up = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = Window.partitionBy("community").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, -1)
    replaced = F.when(F.col("report").isNotNull(), F.col("_r")).otherwise(F.col("context_size"))
    s = s.withColumn("_a", F.sum(replaced).over(up)).withColumn("_b", F.coalesce(F.sum("context_size").over(rest), F.lit(0)))
    s = s.withColumn("_only", F.sum(F.when(F.col("report").isNotNull(), F.col("_r")).otherwise(0)).over(up))
    cut_at = s.groupBy(F.col("community").alias("_c")).agg(
        F.min(F.when(F.col("report").isNotNull() & (F.col("_a") + F.col("_b") <= budget), F.col("_i"))).alias("_fit"), F.coalesce(F.max(F.when(F.col("_only") <= budget, F.col("_i"))), F.lit(0)).alias("_reports")
    )
    j = s.join(cut_at, F.col("community") == F.col("_c"))
    text = F.when(F.col("_fit").isNotNull(), F.when((F.col("_i") <= F.col("_fit")) & F.col("report").isNotNull(), F.col("report")).otherwise(F.col("context"))).otherwise(F.when(F.col("_i") <= F.col("_reports"), F.col("report")))
    return j.withColumn("_text", text).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("_i", "_text")))), lambda x: x["_text"]), "\n").alias("mixed"))


def prepare_level(contexts: DataFrame, reports: DataFrame | None, hierarchy: DataFrame, level: int, budget: int) -> DataFrame:
    """(level, community, context): what the report of each community of a level is written from.

    A context within the budget stays; a larger one is mixed from its sub-communities' reports where
    there are any, else it is the trimmed context.
    """
    here = contexts.where(F.col("level") == level)
    fine = here.where("not exceeds").select("level", "community", "context")
    large = here.where("exceeds")
    if reports is None:
        return fine.unionByName(large.select("level", "community", "context"))
    r = reports.select(F.col("level").alias("_rl"), F.col("community").alias("_rc"), F.col("full_content").alias("report"))
    subs = contexts.select(F.col("level").alias("_sl"), F.col("community").alias("_sc"), F.col("context").alias("_sx"), F.col("context_size").alias("_ss"))
    h = hierarchy.where(F.col("level") == level).join(large.select(F.col("community").alias("_big")), F.col("community") == F.col("_big"), "left_semi")
    rows = h.join(subs, (F.col("sub_level") == F.col("_sl")) & (F.col("sub_community") == F.col("_sc"))).join(r, (F.col("sub_level") == F.col("_rl")) & (F.col("sub_community") == F.col("_rc")), "left")
    mixed = mixed_context(rows.select("community", "sub_community", "report", F.col("_sx").alias("context"), F.col("_ss").alias("context_size")), budget)
    mixed = mixed.select(F.lit(level).alias("level"), "community", F.col("mixed").alias("context"))
    done = mixed.select(F.col("community").alias("_d"))
    rest = large.join(done, F.col("community").eqNullSafe(F.col("_d")), "left_anti").select("level", "community", "context")
    return fine.unionByName(mixed).unionByName(rest)
