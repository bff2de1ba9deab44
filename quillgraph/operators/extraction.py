"""Verbs that ask a text provider: extraction, covariates, summaries, reports, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.providers import Answer, ask
from quillgraph.functions.session import cut
from quillgraph.operators import context as C
from quillgraph.operators.relational import VerbInput, verb
from quillgraph.operators.vectors import reconstitute

#: Stands for the text in a prompt.
PROMPT = "{text}"
MORE = "{prompt}\n\nWhat was left out:"


def answers_of(units: DataFrame, keys: Sequence[str], text: str, provider: Answer, prompt: str = PROMPT, rounds: int = 0, name: str = "extract") -> DataFrame:
    """(keys, answer): a provider's answer on every text, and on what it left out, ``rounds`` times.

    Every distinct prompt is asked once; each round's answers are materialised.
    """
    asked = units.select(*keys, T.fill_template(prompt, {"text": F.col(text)}).alias("_prompt"))
    out = None
    for k in range(rounds + 1):
        found, _ = ask(asked, "_prompt", provider, name=f"{name}{k}")
        found = cut(found.select(*keys, "_prompt", "answer"))
        out = found.select(*keys, "answer") if out is None else out.unionByName(found.select(*keys, "answer"))
        asked = found.select(*keys, T.fill_template(MORE, {"prompt": F.concat_ws("\n\n", "_prompt", "answer")}).alias("_prompt"))
    return out


def entity_extract(units: DataFrame, unit_id: str, text: str, provider: Answer, prompt: str = PROMPT, gleanings: int = 0, types: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of text units.

    Entities are (unit, name, type, descriptions), relationships (unit, source, target, descriptions,
    weight), one row per unit and name or pair: descriptions are distinct and sorted, weights added
    up. Ends of relationships that no record declares are entities without a type. ``types`` leaves
    out entities of other types.
    """
    raw = answers_of(units, [unit_id], text, provider, prompt, gleanings).where("answer is not null")
    e = T.parse_entities(raw, "answer", [unit_id])
    if types is not None:
        e = e.where(F.col("type").isin([t.upper() for t in types]))
    r = cut(T.parse_relationships(raw, "answer", [unit_id], parse_weight=True))
    lines = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    ends = r.select(unit_id, F.explode(F.array("source", "target")).alias("name")).distinct().select(unit_id, "name", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("description"))
    every = e.select(unit_id, "name", "type", "description").unionByName(ends)
    entities = every.groupBy(unit_id, "name").agg(F.max("type").alias("type"), lines("description").alias("descriptions"))
    ordered = r.select(unit_id, F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "description", "weight")
    relationships = ordered.groupBy(unit_id, "source", "target").agg(lines("description").alias("descriptions"), F.sum("weight").alias("weight"))
    return entities, relationships


def extract_covariates(units: DataFrame, unit_id: str, text: str, provider: Answer, covariate_type: str = "claim", prompt: str = PROMPT, gleanings: int = 0) -> DataFrame:
    """(unit, pos, covariate_type, claim fields): a row per claim; claims without a description go."""
    raw = answers_of(units, [unit_id], text, provider, prompt, gleanings, "claims").where("answer is not null")
    claims = T.parse_claims(raw, "answer", [unit_id]).where("description is not null and description <> ''")
    return claims.select(unit_id, "pos", F.lit(covariate_type).alias("covariate_type"), *T.CLAIM_FIELDS)


def summarize_descriptions(rows: DataFrame, keys: Sequence[str], description: str, provider: Answer, max_tokens: int = 4000, prompt: str = "{name}\n{text}") -> DataFrame:
    """(keys, n, summary): the descriptions of a key as one text.

    No description gives an empty summary, a single one itself. Of several, distinct and in order, as
    many as fit the budget are summarised; the summary then stands before the next ones, until none is
    left. A key's descriptions are read as a sorted stream and never held together.
    """
    d = rows.select(*keys, F.col(description).alias("_d")).distinct().repartition(*keys).sortWithinPartitions(*keys, "_d")
    size = lambda s: len(s.split())

    def run(stream):
        group, seen, held, used = None, 0, [], 0

        def fold(last: bool) -> str:
            nonlocal held, used
            if not held:
                return ""
            if len(held) == 1 and (last and seen == 1 or not last):
                return held[0]
            name = ", ".join("" if x is None else str(x) for x in group)
            made = provider(prompt.replace("{name}", name).replace("{text}", "\n".join(held))) if len(held) > 1 else held[0]
            held, used = [made], size(made)
            return made

        def pack(done):
            return pa.RecordBatch.from_arrays(
                [*[pa.array([g[i] for g, *_ in done], kinds[i]) for i in range(len(keys))], pa.array([n for _, n, _ in done], pa.int64()), pa.array([s for *_, s in done], pa.string())], names=[*keys, "n", "summary"]
            )

        kinds = None
        for batch in stream:
            kinds = kinds or [batch.column(i).type for i in range(len(keys))]
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, text = row[:-1], row[-1]
                if name != group:
                    if group is not None:
                        done.append((group, seen, fold(True)))
                    group, seen, held, used = name, 0, [], 0
                if text:
                    if len(held) > 1 and used + size(text) > max_tokens:
                        fold(False)
                    held.append(text)
                    used, seen = used + size(text), seen + 1
            if done:
                yield pack(done)
        if group is not None:
            yield pack([(group, seen, fold(True))])

    types = dict(rows.dtypes)
    return d.mapInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "n long", "summary string"]))


def community_reports(contexts: DataFrame, hierarchy: DataFrame, levels: Sequence[int], provider: Answer, budget: int, prompt: str = PROMPT) -> tuple[DataFrame, DataFrame]:
    """(prepared contexts, reports) of communities, the deepest level first.

    A level whose contexts exceed the budget takes the reports of the levels below in their place. A
    community whose answer is missing or empty has no report. Every level is materialised.
    """
    reports = out = None
    for level in levels:
        prepared = cut(C.prepare_level(contexts, reports, hierarchy, level, budget))
        asked = prepared.select("level", "community", T.fill_template(prompt, {"text": F.col("context")}).alias("_prompt"))
        found, _ = ask(asked, "_prompt", provider, name="report")
        new = cut(found.where("answer is not null and answer <> ''").select("level", "community", F.col("answer").alias("full_content")))
        reports = new if reports is None else reports.unionByName(new)
        out = prepared if out is None else out.unionByName(prepared)
    return out, reports


#: Pieces packed into requests by one task.
EMBED_GROUP = 4096


def text_embed(rows: DataFrame, id_col: str, text: str, embed: Callable[[Column], Column], max_tokens: int = 8191, batch_rows: int = 16) -> tuple[DataFrame, DataFrame]:
    """(embeddings, pieces): a vector per row, from pieces of ``max_tokens`` at most.

    ``pieces`` is (id, chunk_no, chunk, n_tokens, batch): what one request may hold, ``batch_rows``
    pieces and ``max_tokens`` tokens at most, packed within groups of about EMBED_GROUP pieces by the row's hash. A row
    of several pieces has their unit mean; one without tokens has no vector.
    """
    pieces = T.token_windows(rows, [id_col], text, id_col, max_tokens, 0).select(id_col, "chunk_no", "chunk", "n_tokens")
    pieces = cut(pieces)
    # Groups of about EMBED_GROUP pieces are packed apart, so tasks grow in number with the corpus.
    groups = max(1, -(-pieces.count() // EMBED_GROUP))
    spread = pieces.withColumn("_part", F.pmod(F.xxhash64(id_col), F.lit(groups)))
    packed = cut(C.pack_batches(spread, ["_part"], [id_col, "chunk_no"], "n_tokens", max_tokens, batch_rows=batch_rows))
    vectors = packed.select(id_col, embed(F.col("chunk")).alias("_v"))
    return reconstitute(vectors, id_col, "_v"), packed.select(id_col, "chunk_no", "chunk", "n_tokens", F.concat_ws("-", F.col("_part").cast("string"), F.col("batch").cast("string")).alias("batch"))


def fits_one_chunk(text: Column, max_tokens: int) -> Column:
    """Whether a text needs no split."""
    return T.num_tokens(text) <= max_tokens


# -- typed rows ------------------------------------------------------------------------------------


def typed(df: DataFrame, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """Columns of stated types: a required one must be there, hold no null and be readable in its type.

    An optional column that is missing or null is null; a text of a list type is split at commas.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    have = dict(df.dtypes)

    def read(name: str, kind: str, must: bool) -> Column:
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        c = F.col(name)
        if kind.startswith("array") and have[name] == "string":
            value = F.transform(T.split_text(c), lambda x: F.trim(x).try_cast(kind[6:-1]))
        else:
            value = c.try_cast(kind) if have[name] == "string" else c.cast(kind)
        wrong = value.isNull() & (F.lit(must) | c.isNotNull())
        return F.when(wrong, F.raise_error(F.concat(F.lit(f"column {name} is no {kind}: "), F.coalesce(c.cast("string"), F.lit("null")))).cast(kind)).otherwise(value).alias(name)

    return df.select(*[read(n, k, True) for n, k in required.items()], *[read(n, k, False) for n, k in (optional or {}).items()])


def by_key(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Rows whose key is one of the values, dashes or not (as in two spellings of a uuid)."""
    return df.where(F.replace(F.col(key).cast("string"), F.lit("-"), F.lit("")).isin([v.replace("-", "") for v in values]))


def by_attribute(df: DataFrame, attributes: str, name: str, value: str) -> DataFrame:
    """Rows whose map of attributes has the value under the name."""
    return df.where(F.try_element_at(F.col(attributes), F.lit(name)).cast("string") == value)


def harmonic_mean(a: Column, b: Column) -> Column:
    """Of two means, 0 where both are 0."""
    return F.coalesce(F.try_divide(2 * a * b, a + b), F.lit(0.0))


def token_account(answers: DataFrame, prompt: str, answer: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, calls, prompt_tokens, answer_tokens) of distinct prompts that were answered."""
    d = answers.where(F.col(answer).isNotNull()).select(*by, prompt, answer).distinct()
    return d.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(T.num_tokens(F.col(prompt))).alias("prompt_tokens"), F.sum(T.num_tokens(F.col(answer))).alias("answer_tokens"))


# -- as verbs of workflows ---------------------------------------------------------------------------


@verb("entity_extract")
def entity_extract_verb(t: VerbInput, column: str, id_column: str, provider: Answer, to: str = "entities", prompt: str = PROMPT, gleanings: int = 0, entity_types: Sequence[str] | None = None) -> DataFrame:
    """The entities, or the relationships, of a table's texts."""
    if to not in ("entities", "relationships"):
        raise ValueError(f"unknown output {to!r}")
    return entity_extract(t.source, id_column, column, provider, prompt, gleanings, entity_types)[to == "relationships"]


@verb("extract_covariates")
def extract_covariates_verb(t: VerbInput, column: str, id_column: str, provider: Answer, covariate_type: str = "claim", prompt: str = PROMPT, gleanings: int = 0) -> DataFrame:
    return extract_covariates(t.source, id_column, column, provider, covariate_type, prompt, gleanings)


@verb("summarize_descriptions")
def summarize_descriptions_verb(t: VerbInput, keys: Sequence[str], column: str, provider: Answer, max_tokens: int = 4000) -> DataFrame:
    return summarize_descriptions(t.source, list(keys), column, provider, max_tokens)


@verb("text_embed")
def text_embed_verb(t: VerbInput, column: str, id_column: str, embed: Callable[[Column], Column], to: str = "embedding", max_tokens: int = 8191, batch_rows: int = 16) -> DataFrame:
    """The table with a vector per row, null where a text has no tokens."""
    made = text_embed(t.source, id_column, column, embed, max_tokens, batch_rows)[0].select(F.col(id_column).alias("_k"), F.col("embedding").alias(to))
    return t.source.join(made, F.col(id_column) == F.col("_k"), "left").drop("_k")


@verb("chunk")
def chunk_verb(t: VerbInput, column: str, id_column: str, keys: Sequence[str] | None = None, size: int = 300, overlap: int = 100) -> DataFrame:
    """Token windows of the texts of each group (of each row, without ``keys``)."""
    return T.token_windows(t.source, list(keys or [id_column]), column, id_column, size, overlap)


@verb("create_community_reports")
def community_reports_verb(t: VerbInput, provider: Answer, levels: Sequence[int], budget: int = 8000, prompt: str = PROMPT) -> DataFrame:
    """Reports of the communities whose contexts are the source and whose hierarchy is the other table."""
    return community_reports(t.source, t.others[0], levels, provider, budget, prompt)[1]
