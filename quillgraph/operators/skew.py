"""Joins that no hot key can hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.session import cut

#: A key is hot if it holds more than one of so many rows; so there are fewer hot keys than this.
SHARES = 1000


def look_up(rows: DataFrame, key: str, table: DataFrame, table_key: str, hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of the row of ``table`` whose ``table_key`` equals ``key`` (unique there).

    The table's rows of hot keys, SHARES at most, are broadcast, and rows that have one do not move;
    all others are joined by key, where a task meets a share of one in SHARES at most. ``hot`` gives
    the table's hot rows if they are known; else keys are counted, added up before the shuffle.
    Frames that take long should be materialised. ``how`` is inner or left; column names must not clash.
    """
    if hot is None:
        counts = rows.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n"))
        many = counts.where(F.col("_n") > max(1, rows.count() // SHARES)).select("_hot")
        hot = cut(table.join(F.broadcast(many), F.col(table_key) == F.col("_hot"), "left_semi"))
    names = {c: f"_hot_{c}" for c in table.columns}
    met = rows.join(F.broadcast(hot.select(*[F.col(c).alias(names[c]) for c in table.columns])), F.col(key) == F.col(names[table_key]), "left")
    done = met.where(F.col(names[table_key]).isNotNull()).select(*rows.columns, *[F.col(names[c]).alias(c) for c in table.columns])
    rest = met.where(F.col(names[table_key]).isNull()).select(*rows.columns).join(table, F.col(key) == F.col(table_key), how)
    return done.unionByName(rest.select(*rows.columns, *table.columns))
