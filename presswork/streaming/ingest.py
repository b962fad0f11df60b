"""Incremental ingest: feed answers arriving as files become items once, late ones included, and feed a registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from presswork.schemas import PAYLOAD
from presswork.sources.readers import payload_items


def stream_payloads(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    s = spark.readStream.schema(PAYLOAD).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return s.withColumn("cached_path", F.col("_metadata.file_path"))


def stream_items(payloads: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Items of a stream of answers, each record_id once within the watermark of retrieved_at. State older than that is
    dropped, so it does not grow with the history; the history itself is checked by the batch operators."""
    return payload_items(payloads).withWatermark("retrieved_at", lateness).dropDuplicatesWithinWatermark(["record_id"])


def windowed_counts(events: DataFrame, at: str, key: str, size: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts per tumbling or sliding window and key; late rows count until the watermark has passed their window."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.withWatermark(at, lateness).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def start(df: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run a stream into a function of (batch, number); the checkpoint makes it resume where it ended.

    After a failure the last batch comes again under its number, so the function must replace by number what it wrote
    (writers.write_batch) or merge by key; plain appending would double its rows.
    """
    writer = df.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
