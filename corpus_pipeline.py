"""A corpus from raw documents: language, near copies, benchmark leaks, personal data, mix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.session import cut, free_name, remove, shared_dir
from quillgraph.llm.decontaminate import drop_leaks
from quillgraph.llm.jaccard import BROADCAST_DOCS, jaccard_components
from quillgraph.llm.langid import fit_language_model, keep_identified
from quillgraph.llm.mixing import mix_documents
from quillgraph.llm.pii import mask_pii
from quillgraph.llm.text import least_row


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others go."""
    return keep_identified(docs, fit_language_model(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id.

    Rows without an id or without words are in no group and stay. Rows of one id are told apart by
    their texts: those that are no copies of each other stay, each for its own group (of one id the
    text of the least SHA-256 stands for a group); of rows equal in id and text the least stays.
    """
    several = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    one, row = free_name("one", docs.columns), free_name("row", docs.columns)
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    identity = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id"), sha)) if several else F.col("doc_id")
    groups = jaccard_components(docs.select(identity.alias("doc_id"), "text"))
    gone = cut(groups.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias(one)).distinct())
    # An identity is a number, or one and a hash: 64 bytes a row bound what is broadcast.
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_DOCS else gone, identity == F.col(one), "left_anti")
    if not several:
        return kept
    kept = cut(kept.withColumn(one, identity))
    worded = F.regexp_like(F.col("text"), F.lit(r"[^\x20\x09-\x0D]"))
    twice = kept.where(worded & F.col(one).isNotNull()).groupBy(F.col(one).alias(row)).count().where("count > 1").select(row)
    twice = cut(twice)
    few = F.broadcast(twice) if twice.count() <= BROADCAST_DOCS else twice
    single = kept.join(few, F.col(one) == F.col(row), "left_anti").select(*[f"`{c}`" for c in docs.columns])
    alike = kept.join(few, F.col(one) == F.col(row), "left_semi")
    least = alike.groupBy(one).agg(least_row(alike, docs.columns).alias(row))
    return single.unionByName(least.select(f"{row}.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, found personal data masked."""
    return mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, whole, with their words taken and how often."""
    return mix_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("PII", remove_personal_data),
    ("mixing sources", mix_sources),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    result = cut(docs)
    remove(spark, folder)
    return result
