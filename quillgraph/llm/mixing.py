"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.session import cut, free_name
from quillgraph.llm.text import least_row

#: Rows that one window task may hold; sets the number of stretches a queue is cut into.
STRETCH_ROWS = 4096
#: A source is read at most this many times.
PASSES = 2
WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, passes: int = PASSES) -> DataFrame:
    """(source, source_size, n_docs, target) of every source.

    Sources in code-point order, null last, weigh ``weights`` in turn. They share ``share`` times
    all words; a target stops at ``passes`` times its source's size and the excess is shared anew by
    weight. That sharing ends where every free target is level * weight for one level, which is
    found in one pass over the sources sorted by cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    w = per.withColumn("nth", F.row_number().over(order)).withColumn("weight", weight)
    w = w.withColumn("cap", F.col("source_size") * float(passes)).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    w = w.withColumn("capped", F.coalesce(F.sum("cap").over(rising), F.lit(0.0)))
    w = w.withColumn("free_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    w = w.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("free_weight"))
    # Past the right place in the order the levels fall, before it they exceed the ratio.
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    w = w.withColumn("level", level)
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return w.select("source", "source_size", "n_docs", target.alias("target"))


def _running(df: DataFrame, keys: list[str], stretch: str, order: list, value: str, out: str) -> DataFrame:
    """Running sum of ``value`` before each row within ``keys``, in the order (stretch, order).

    The sums of whole stretches are few and are added up first; each stretch is then summed on its
    own, so no task holds more than a stretch however large a key is.
    """
    # A key's stretches are many rows short of its rows, so this window is small.
    before = Window.partitionBy(*keys).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    heads = df.groupBy(*keys, stretch).agg(F.sum(value).alias("_part")).withColumn("_base", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    renamed = heads.select(*[F.col(k).alias(f"_h_{k}") for k in [*keys, stretch]], "_base")
    cond = F.lit(True)
    for k in [*keys, stretch]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    joined = df.join(renamed, cond, "left").select(*df.columns, "_base")
    inside = Window.partitionBy(*keys, stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_base")


def fair_queue(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, print) of every row of ``docs``.

    Every source is a queue of its documents, shuffled by md5(doc_id) and read up to twice. A
    document's virtual finish time is its queue's words up to its end over the queue's target.
    Finish times are sorted by range over all sources and cut where the words reach the budget, so
    each source ends near its target; the document that reaches the budget is still taken whole,
    unless its source is then past its target. Null text has size 0, null source is a source of its
    own (last), repeated rows count each; an empty table gives no rows. Other columns are not read.
    ``print`` is a 64-bit hash of the text, which orders rows of one doc_id and size.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = cut(docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), F.md5(F.col("doc_id").cast("string")).alias("key"), F.xxhash64("text").alias("print")))
    targets = cut(source_targets(sizes, weights, share))
    totals = targets.agg(F.coalesce(F.max("n_docs"), F.lit(0)).alias("most"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("rows")).first()
    digits = 1  # hex digits of the key that make a stretch of about STRETCH_ROWS rows at most
    while totals["most"] > STRETCH_ROWS * 16**digits // 4 and digits < 8:
        digits += 1
    wide = sizes.alias("d").join(F.broadcast(targets).alias("t") if totals["rows"] and targets.count() <= 100_000 else targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    wide = wide.select("d.doc_id", "d.source", "d.size", "d.key", "d.print", "t.source_size", "t.target").withColumn("stretch", F.substring(F.coalesce("key", F.lit("")), 1, digits))
    queued = cut(_running(wide, ["source"], "stretch", ["key", "doc_id", "size", "print"], "size", "start"))

    copy = F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias("pass")
    copies = queued.where("size > 0 and target > 0").select("doc_id", "source", "size", "source_size", "target", "start", copy)
    copies = copies.withColumn("finish", (F.col("start") + F.col("size") + F.col("pass") * F.col("source_size")) / F.col("target"))
    # A queue past its target (by more than its last document) has nothing left to give.
    copies = copies.where((F.col("start") + F.col("pass") * F.col("source_size")) < F.col("target"))
    ranges = max(16, -(-int(totals["rows"]) * PASSES // STRETCH_ROWS))
    copies = copies.withColumn("stretch", F.floor(F.least(F.col("finish"), F.lit(2.0)) * ranges)).withColumn("all", F.lit(0))
    ordered = _running(copies, ["all"], "stretch", ["finish", "doc_id", "pass", "source"], "size", "served")
    budget = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("budget")).first()["budget"]
    kept = ordered.where(F.col("served") < F.lit(float(budget)))
    taken = kept.groupBy("doc_id", "source", "start").agg(F.sum("size").alias("taken"), F.count("*").alias("copies"))
    q, k = queued.alias("q"), taken.alias("k")
    cond = F.col("q.doc_id").eqNullSafe(F.col("k.doc_id")) & F.col("q.source").eqNullSafe(F.col("k.source")) & (F.col("q.start") == F.col("k.start")) & (F.col("q.size") > 0)
    return q.join(k, cond, "left").select(
        "q.doc_id", "q.source", "q.size", "q.source_size", "q.target", F.coalesce("k.taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("k.copies", F.lit(0)).cast("int").alias("copies"), "q.print"
    )


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """The documents that the mix takes: all columns of ``docs``, then size, source_size, target, taken, copies.

    Columns of ``docs`` with one of those five names are replaced. Rows equal in doc_id, source and
    text are one row of the result, their taken words and copies added up; of such rows that differ in
    other columns the least stays. Texts are shuffled once, by doc_id.
    """
    queue = fair_queue(docs, weights, share).where("copies > 0")
    extra = ["size", "source_size", "target", "taken", "copies"]
    keys = ["doc_id", "source", "print"]
    sums = [F.sum(c).cast("int" if c == "copies" else "long").alias(c) if c in ("taken", "copies") else F.first(c).alias(c) for c in extra]
    taken = cut(queue.groupBy(*keys).agg(*sums, F.count("*").alias("rows")))
    columns = [c for c in docs.columns if c not in extra]
    d, t = docs.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64("text").alias(free_name("print", docs.columns))).alias("d"), taken.alias("t")
    mine = free_name("print", docs.columns)
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col(f"d.{mine}") == F.col("t.print"))
    joined = lambda part: d.join(part.alias("t"), same).select(*[F.col(f"d.`{c}`") for c in columns], *[F.col(f"t.{c}") for c in extra])
    repeated = taken.where("rows > 1")
    if repeated.isEmpty():
        return joined(t)
    group = free_name("group", [*columns, *extra])
    several = d.join(repeated.alias("t"), same).select(*[F.col(f"d.`{c}`") for c in columns], *[F.col(f"t.{c}") for c in extra], F.struct(*[F.col(f"t.{k}") for k in keys]).alias(group))
    least = several.groupBy(group).agg(least_row(several, [*columns, *extra]).alias("row"))
    return joined(taken.where("rows = 1")).unionByName(least.select("row.*"))


def op2_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted fair queueing over all ``documents``."""
    mixed = fair_queue(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in DuckDB over a table ``docs`` of (doc_id, source, size).
MIX_SQL = """
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
wt AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight,
    row_number() OVER (ORDER BY source IS NULL, encode(source)) AS nth, source_size * 2.0::DOUBLE AS cap FROM per),
lv AS (SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS lvl FROM wt),
lm AS (SELECT max(lvl) AS l FROM lv WHERE lvl <= ratio),
tg AS (SELECT source, source_size, CASE WHEN l IS NULL OR ratio <= l THEN cap ELSE l * weight END AS target FROM lv, lm),
qd AS (SELECT s.*, t.source_size, t.target, CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN tg t ON s.source IS NOT DISTINCT FROM t.source),
cp AS (SELECT qd.*, p.pass, (start + size + p.pass * source_size) / target AS finish FROM qd, (VALUES (0), (1)) p(pass)
  WHERE size > 0 AND target > 0 AND start + p.pass * source_size < target),
sv AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, doc_id, pass, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS served FROM cp),
tk AS (SELECT doc_id, source, start, CAST(sum(size) AS BIGINT) AS taken FROM sv WHERE served < (SELECT sum(target) FROM tg) GROUP BY ALL)
"""
SIZED_SQL = "sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents)"
OP2_SQL = f"""
WITH {SIZED_SQL}, {MIX_SQL}
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken FROM qd q LEFT JOIN tk k
  ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.source IS NOT DISTINCT FROM k.source AND q.start = k.start AND q.size > 0
"""
