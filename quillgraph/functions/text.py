"""Text columns: cleaning, tokens, windows, sentences, and the extractor's output language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens are runs of non-space characters; every budget is counted in them.
TOKEN = r"\S+"
#: Surrogate entity mentions: capitalised words.
ENTITY = r"\b[A-Z][a-z]+"
RECORD, FIELD, DONE = "##", "<|>", "<|COMPLETE|>"
# The character references that extractor texts use.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def num_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def clean_str(text: Column) -> Column:
    """Trimmed, character references decoded, control characters removed."""
    out = F.trim(text)
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.regexp_replace(out, r"[\x00-\x1f\x7f-\x9f]", "")


def split_text(text: Column, separator: str = ",") -> Column:
    """Parts between separators taken literally; an empty text has none, null stays null."""
    quoted = "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|&#~" else c for c in separator)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, quoted))


def replace_all(text: Column, replacements: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after another."""
    for old, new in replacements:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` of a template replaced by columns."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def clean_json(text: Column) -> Column:
    """JSON out of a model's answer: what a code fence holds, else the whole, from its first to its last bracket.

    If that is no JSON, quotes written with a backslash, and doubled braces, are read as single ones.
    """
    fenced = F.regexp_extract(text, r"(?s)```[a-zA-Z]*\s*(.*?)```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), r"(?s)[{\[].*[}\]]", 0)
    single = F.regexp_replace(F.regexp_replace(body, r'\\+(["n])', '$1'), r"([{}])\1", "$1")
    reads = lambda c: F.from_json(c, "map<string,string>").isNotNull() | F.from_json(c, "array<string>").isNotNull()
    return F.when(reads(body), body).otherwise(single)


def parse_rating(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(-1.0))


def token_windows(df: DataFrame, keys: Sequence[str], text: str, order: str, size: int = 300, overlap: int = 100, doc_id: str | None = None) -> DataFrame:
    """Windows of ``size`` tokens every ``size - overlap`` over the joined texts of each group.

    (keys, chunk_no, chunk, n_tokens, document_ids). Texts of a group join in ``order``; a group
    without tokens has no window; ``document_ids`` are the documents whose tokens a window holds.
    """
    step = size - overlap
    if step <= 0 or size <= 0:
        raise ValueError("size must be positive and exceed the overlap")
    doc_id = doc_id or order
    one = df.select(*keys, F.col(order).alias("_o"), F.col(doc_id).cast("string").alias("_d"), tokens(F.col(text)).alias("_t"))
    if list(keys) == [doc_id] and doc_id == order:
        grouped = one.select(*keys, F.col("_t").alias("_tokens"), F.array(F.struct(F.lit(0).alias("at"), F.size("_t").alias("n"), F.col("_d").alias("d"))).alias("_docs"))
    else:
        parts = one.where(F.size("_t") > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "_d", "_t"))).alias("_p"))
        ends = F.aggregate("_p", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(p["_t"]))))
        grouped = parts.withColumn("_e", ends).select(
            *keys, F.flatten(F.transform("_p", lambda p: p["_t"])).alias("_tokens"), F.transform("_p", lambda p, i: F.struct(F.get("_e", i).alias("at"), F.size(p["_t"]).alias("n"), p["_d"].alias("d"))).alias("_docs")
        )
    starts = F.explode(F.sequence(F.lit(0), F.size("_tokens") - 1, F.lit(step)))
    cut = grouped.where(F.size("_tokens") > 0).select(*keys, starts.alias("_s"), "_tokens", "_docs")
    part = F.slice("_tokens", F.col("_s") + 1, size)
    held = F.filter("_docs", lambda d: (d["n"] > 0) & (d["at"] < F.col("_s") + size) & (d["at"] + d["n"] > F.col("_s")))
    return cut.select(
        *keys, (F.col("_s") / step).cast("long").alias("chunk_no"), F.array_join(part, " ").alias("chunk"), F.size(part).cast("long").alias("n_tokens"), F.array_distinct(F.transform(held, lambda d: d["d"])).alias("document_ids")
    )


def sentences(text: Column) -> Column:
    """Trimmed runs up to ``.``, ``!``, ``?`` or a line end, with their punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")


# -- extractor output ----------------------------------------------------------------------------


def _fields(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, f): fields of every record; completion marker, one leading ( and one trailing ) are removed."""
    record = F.posexplode(F.split(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(DONE), F.lit("")), RECORD))
    rows = df.select(*keys, record.alias("pos", "record"))
    bare = F.regexp_replace(F.regexp_replace(F.trim("record"), r"^\(", ""), r"\)$", "")
    return rows.select(*keys, "pos", F.split(bare, r"<\|>").alias("f"))


def _name(f: Column) -> Column:
    return clean_str(F.upper(f))


def parse_entities(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, name, type, description) of ``("entity"<|>name<|>type<|>description)`` records."""
    f = F.col("f")
    rows = _fields(df, text, keys).where((f[0] == '"entity"') & (F.size(f) >= 4))
    return rows.select(*keys, "pos", _name(f[1]).alias("name"), _name(f[2]).alias("type"), clean_str(f[3]).alias("description"))


def parse_relationships(df: DataFrame, text: str, keys: Sequence[str], parse_weight: bool = False) -> DataFrame:
    """(keys, pos, source, target, description, weight); the weight is 1.0 unless it is to be parsed."""
    f = F.col("f")
    rows = _fields(df, text, keys).where((f[0] == '"relationship"') & (F.size(f) >= 5))
    weight = F.coalesce(F.trim(F.element_at(f, -1)).try_cast("double"), F.lit(1.0)) if parse_weight else F.lit(1.0)
    return rows.select(*keys, "pos", _name(f[1]).alias("source"), _name(f[2]).alias("target"), clean_str(f[3]).alias("description"), weight.alias("weight"))


CLAIM_FIELDS = ("subject_id", "object_id", "type", "status", "start_date", "end_date", "description", "source_text")


def parse_claims(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, claim fields): missing fields are null, the completion marker is skipped."""
    rows = _fields(df, text, keys).where((F.size("f") > 1) | (F.get("f", F.lit(0)) != ""))
    return rows.select(*keys, "pos", *[F.trim(F.get("f", F.lit(i))).alias(name) for i, name in enumerate(CLAIM_FIELDS)])


def parse_points(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys, description, score) of ``{"points": [...]}``; nothing readable gives one empty point of score 0."""
    read = F.from_json(clean_json(F.col(text)), "points array<struct<description:string,score:double>>")["points"]
    none = F.array(F.struct(F.lit("").alias("description"), F.lit(0.0).alias("score")))
    points = F.when(read.isNotNull() & (F.size(read) > 0), read).otherwise(none)
    return df.select(*keys, F.explode(points).alias("p")).select(*keys, F.coalesce("p.description", F.lit("")).alias("description"), F.coalesce("p.score", F.lit(0.0)).alias("score"))


def render_report(title: Column, summary: Column, findings: Column) -> Column:
    """Title, summary and findings (array of struct<summary, explanation>) as one marked-up text."""
    parts = F.array_join(F.transform(findings, lambda f: F.concat(F.lit("## "), f["summary"], F.lit("\n\n"), f["explanation"])), "\n\n")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), summary, F.lit("\n\n"), parts)
