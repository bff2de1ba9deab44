"""Streams beyond the batch engine: incremental windows of texts, and conversation groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.functions.text import ENTITY, token_windows


def incremental_windows(stream: DataFrame, path: str, checkpoint: str, size: int = 300, overlap: int = 100) -> StreamingQuery:
    """Append the token windows of newly arrived documents (doc_id, text) to a Parquet table.

    A batch writes its own folder, so a batch that runs twice replaces its rows.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        token_windows(batch, ["doc_id"], "text", "doc_id", size, overlap).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mention_counts(stream: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Entity mentions by event-time window; rows later than the watermark are dropped by Spark."""
    names = F.explode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("name")
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).select(F.col(time), names).groupBy(F.window(time, window), "name").agg(F.count("*").alias("mentions"))


def event_windows(stream: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and value sums by window and type."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
