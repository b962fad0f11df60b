"""Queries that run a stream to its end over a table's files and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.session import new_path
from presswork.sources.writers import write_batch
from presswork.streaming.ingest import start, windowed_counts


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    # watermarks need an instant, the table has local times in UTC
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_hourly_counts(spark, d):
    """Events per hour and type; every trigger rewrites the whole result, so the last windows are there too."""
    out = new_path(spark, "hourly")
    counts = windowed_counts(_events(spark, d), "ts", "event_type", "1 hour")
    query = counts.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out))
    query.option("checkpointLocation", new_path(spark, "hourly-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.unix_seconds("window_start").alias("start_s"), "event_type", "n")


def stream_first_events(spark, d):
    """Each event once, by a stream that drops repeats within its watermark, per type."""
    out = new_path(spark, "events")
    once = _events(spark, d).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
    start(once, lambda df, n: write_batch(df, n, out), new_path(spark, "events-state")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


QUERIES = {f.__name__: f for f in (stream_hourly_counts, stream_first_events)}
ORACLE = {
    "stream_hourly_counts": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2",
    "stream_first_events": "SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT event_id)::BIGINT AS ids FROM events GROUP BY 1",
}
