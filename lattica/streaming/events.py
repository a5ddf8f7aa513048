"""Event-count indicators as Structured Streaming, with a batch form of the same sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, max_files: int = 1) -> DataFrame:
    """A stream over Parquet files that land in ``folder``; ts becomes a zoned timestamp, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, length: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) per tumbling window; with ``late`` a watermark for append mode."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy(F.window("ts", length).alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("_w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, session_start, n) per session that a gap ends."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy(F.session_window("ts", gap).alias("_w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("_w.start").alias("session_start"), "n")
