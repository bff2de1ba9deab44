"""Sources and sinks: text and CSV corpora, tables, snapshots, vector and property-graph tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GROUP = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")


def _java_pattern(pattern: str) -> tuple[str, list[str]]:
    """A Python pattern's named groups by number, in Java's syntax."""
    return _GROUP.sub(r"(?<\1>", pattern), _GROUP.findall(pattern)


def _path_groups(path: Column, pattern: str) -> dict[str, Column]:
    java, names = _java_pattern(pattern)
    return {n: F.regexp_extract(path, java, re.compile(pattern).groupindex[n]) for n in names}


def find_files(spark: SparkSession, folder: str, pattern: str, file_filter: dict[str, str] | None = None, max_count: int | None = None) -> DataFrame:
    """(path, named groups) of the files whose path fits ``pattern`` and whose groups fit ``file_filter``."""
    java, _ = _java_pattern(pattern)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").where(F.col("path").rlike(java))
    out = files.select("path", *[c.alias(n) for n, c in _path_groups(F.col("path"), pattern).items()])
    for name, wanted in (file_filter or {}).items():
        out = out.where(F.col(name).rlike(f"^(?:{wanted})"))
    return out.orderBy("path").limit(max_count) if max_count else out


def read_texts(spark: SparkSession, folder: str, pattern: str = r".*[\\/](?P<name>[^\\/]+)\.txt$", file_filter: dict[str, str] | None = None) -> DataFrame:
    """(id, title, text, named groups): a row per text file; id is md5 of groups and text, title the file name."""
    java, _ = _java_pattern(pattern)
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_path")).where(F.col("_path").rlike(java))
    groups = _path_groups(F.col("_path"), pattern)
    out = rows.withColumns(groups)
    for name, wanted in (file_filter or {}).items():
        out = out.where(F.col(name).rlike(f"^(?:{wanted})"))
    title = F.element_at(F.split("_path", "/"), -1)
    return out.withColumn("title", title).withColumn("id", F.md5(F.concat_ws("", *groups, "text"))).select("id", "title", "text", *groups)


def read_csv(spark: SparkSession, folder: str, encoding: str = "iso-8859-1", source: str | None = None, text: str | None = None, title: str | None = None, timestamp: str | None = None, timestamp_format: str | None = None) -> DataFrame:
    """CSV rows with id (md5 of the row where there is none), source/text/title copies and date parts."""
    df = spark.read.csv(folder, header=True, encoding=encoding, recursiveFileLookup=True, pathGlobFilter="*.csv", multiLine=True, escape='"')
    if "id" not in df.columns:
        df = df.withColumn("id", F.md5(F.concat_ws("", *df.columns)))
    for to, c in (("source", source), ("text", text), ("title", title)):
        if c and to not in df.columns:
            df = df.withColumn(to, F.col(c))
    if timestamp:
        at = F.to_timestamp(F.col(timestamp), timestamp_format) if timestamp_format else F.to_timestamp(timestamp)
        df = df.withColumn("timestamp", at).withColumns({p: getattr(F, p)("timestamp") for p in ("year", "month")} | {"day": F.dayofmonth("timestamp"), "hour": F.hour("timestamp"), "minute": F.minute("timestamp"), "second": F.second("timestamp")})
    return df


def load_input(spark: SparkSession, kind: str, folder: str, **how) -> DataFrame:
    """Text or CSV input of any store that Spark reads."""
    if kind == "text":
        return read_texts(spark, folder, **how)
    if kind == "csv":
        return read_csv(spark, folder, **how)
    if kind in ("parquet", "json", "orc"):
        return spark.read.format(kind).load(folder)
    raise ValueError(f"unknown input type {kind!r}")


def emit(df: DataFrame, folder: str, name: str, kinds: Sequence[str] = ("parquet",)) -> None:
    """Write a table as Parquet, JSON lines or CSV (nested columns as JSON) under ``folder/name.kind``."""
    for kind in kinds:
        path = f"{folder}/{name}.{kind}"
        if kind == "csv":
            flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
            flat.write.mode("overwrite").csv(path, header=True)
        elif kind in ("json", "parquet", "orc"):
            df.write.mode("overwrite").format(kind).save(path)
        else:
            raise ValueError(f"unknown output type {kind!r}")


def snapshot(df: DataFrame, folder: str, name: str, formats: Sequence[str] = ("parquet",)) -> DataFrame:
    """Write and pass through."""
    emit(df, folder, name, formats)
    return df


def snapshot_rows(df: DataFrame, folder: str, base: str, key: str, column: str | None = None, kind: str = "json") -> None:
    """One folder per row key, holding the row (or one column) as text; for tables of few rows."""
    value = F.col(column).cast("string") if column else F.to_json(F.struct(*df.columns))
    df.select(F.concat(F.lit(f"{base}."), F.col(key).cast("string")).alias("name"), value.alias("value")).write.mode("overwrite").partitionBy("name").text(f"{folder}/{kind}")


def write_vectors(df: DataFrame, path: str, vector: str = "vector", overwrite: bool = True) -> None:
    """Vector store table: rows without a vector are left out."""
    df.where(F.col(vector).isNotNull()).write.mode("overwrite" if overwrite else "append").parquet(path)


# -- property graph --------------------------------------------------------------------------------


def table_edges(df: DataFrame, source: str, target: str, relation: str, properties: Sequence[str] = ()) -> DataFrame:
    """(src, dst, relation, properties JSON) of a table's rows."""
    props = F.to_json(F.struct(*properties)) if properties else F.lit("{}")
    return df.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).cast("string").alias("src"), F.col(target).cast("string").alias("dst"), F.lit(relation).alias("relation"), props.alias("properties"))


def chain_edges(df: DataFrame, node: str, order: Sequence[str], relation: str = "NEXT", partition: Sequence[str] = ()) -> DataFrame:
    """Edges from each row to the next in order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*partition).orderBy(*order)
    rows = df.select(F.col(node).cast("string").alias("src"), F.lead(F.col(node).cast("string")).over(w).alias("dst"))
    return rows.where("dst is not null").select("src", "dst", F.lit(relation).alias("relation"), F.lit("{}").alias("properties"))


def index_graph(documents: DataFrame, units: DataFrame, entities: DataFrame, relationships: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """(src_type, src, relation, dst_type, dst): the edges among index tables.

    documents (id, text_unit_ids), units (id, entity_ids, relationship_ids), entities (id, name),
    relationships (id, source, target), communities (id, relationship_ids, text_unit_ids).
    """

    def edges(df: DataFrame, src_type: str, src: str, dst_type: str, dst: str, relation: str, many: bool = True) -> DataFrame:
        end = F.explode(F.array_distinct(dst)) if many else F.col(dst)
        rows = df.select(F.col(src).cast("string").alias("src"), end.alias("dst")).where("src is not null and dst is not null").withColumn("dst", F.col("dst").cast("string"))
        # Kinds of edges are told apart by their constants, which need not be shuffled.
        return rows.distinct().select(F.lit(src_type).alias("src_type"), "src", F.lit(relation).alias("relation"), F.lit(dst_type).alias("dst_type"), "dst")

    names = entities.select(F.col("name").alias("_n"), F.col("id").cast("string").alias("_i"))
    ends = relationships.select("id", F.explode(F.array_distinct(F.array("source", "target"))).alias("end")).join(names, F.col("end") == F.col("_n"))
    parts = [
        edges(documents, "document", "id", "text_unit", "text_unit_ids", "HAS"),
        edges(units, "text_unit", "id", "entity", "entity_ids", "MENTIONS"),
        edges(units, "text_unit", "id", "relationship", "relationship_ids", "STATES"),
        edges(ends, "relationship", "id", "entity", "_i", "CONNECTS", False),
    ]
    if communities is not None:
        parts += [edges(communities, "community", "id", "relationship", "relationship_ids", "HAS"), edges(communities, "community", "id", "text_unit", "text_unit_ids", "FROM")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert(store: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows merged by key: of each column the last non-null value by ``order``; ``count`` adds up."""
    both = store.unionByName(new, allowMissingColumns=True)
    made = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in both.columns if c not in (key, order, "count")]
    return both.groupBy(key).agg(*made, F.max(order).alias(order), F.sum(F.coalesce("count", F.lit(1))).alias("count") if "count" in both.columns else F.count("*").alias("count"))


def decay(store: DataFrame, by: int = 1) -> DataFrame:
    """Counts lowered; rows that reach zero go."""
    return store.withColumn("count", F.col("count") - by).where("count > 0")
