"""Prompts fitted to a corpus: which texts to show a provider, what to ask, how much fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.providers import Answer
from quillgraph.operators.context import within_budget
from quillgraph.operators.vectors import nearest_to_centroid


def choose_texts(chunks: DataFrame, id_col: str, how: str = "top", limit: int = 15, seed: int = 86, vector: str | None = None, subset: int = 300) -> DataFrame:
    """Rows of ``chunks`` to show: the first, some at random (seeded), or those nearest to the middle of a sample.

    ``top`` goes by id, ``random`` by a hash of it; ``auto`` takes ``subset`` rows at random and of those
    the ``limit`` whose vectors are nearest to their mean.
    """
    drawn = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    if how == "top":
        return chunks.orderBy(id_col).limit(limit)
    if how == "random":
        return chunks.orderBy(drawn, id_col).limit(limit)
    if how == "auto":
        if vector is None:
            raise ValueError("auto needs a vector column")
        sample = chunks.orderBy(drawn, id_col).limit(subset)
        near = nearest_to_centroid(sample, id_col, vector, limit).select(F.col(id_col).alias("_near"))
        return sample.join(F.broadcast(near), F.col(id_col) == F.col("_near"), "left_semi")
    raise ValueError(f"unknown selection {how!r}")


#: What is asked about a corpus, in this order; an answer may be used by the questions after it.
QUESTIONS = {
    "domain": "Name the field that these texts are about.\n\n{texts}",
    "language": "Name the language of these texts.\n\n{texts}",
    "persona": "Describe in one sentence a person who studies relations within {domain}.",
    "entity_types": "As {persona}, list the kinds of things named in these texts, separated by commas.\n\n{texts}",
    "rating": "As {persona}, state in one sentence what makes a report on {domain} important.",
    "role": "As {persona}, describe in one sentence who writes reports on {domain}.",
}


def describe_corpus(texts: list[str], provider: Answer, questions: dict[str, str] | None = None) -> dict[str, str]:
    """A provider's answers about a few chosen texts, each question filled with the answers before it."""
    known = {"texts": "\n\n".join(texts)}
    for name, question in (questions or QUESTIONS).items():
        asked = question
        for k, v in known.items():
            asked = asked.replace("{" + k + "}", v)
        known[name] = provider(asked).strip()
    del known["texts"]
    return known


def fitting_examples(examples: DataFrame, order: str, prompt_tokens: int, max_tokens: int, least: int = 1) -> DataFrame:
    """(nth, input, output): examples in order while they fit beside the prompt; the first ``least`` always."""
    rows = examples.withColumn("_cost", T.num_tokens(F.col("input")) + T.num_tokens(F.col("output")))
    kept = within_budget(rows, "_cost", max(0, max_tokens - prompt_tokens), [order])
    first = rows.orderBy(order).limit(least)
    both = kept.select(order, "input", "output").unionByName(first.select(order, "input", "output")).distinct()
    return both.withColumnRenamed(order, "nth")


def example_block(examples: DataFrame) -> str:
    """The examples as one text, numbered from 1; they are as few as a prompt holds."""
    rows = examples.orderBy("nth").collect()
    return "\n\n".join(f"Example {i}\n{r['input']}\nOutput\n{r['output']}" for i, r in enumerate(rows, 1))
