"""Sliding and tumbling aggregates over an event stream: the time-axis counterpart of sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Count and sum of ``value`` by window and event_type; works on a stream (with a watermark) and on a table alike."""
    src = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if src.isStreaming:
        src = src.withWatermark("ts", late)
    out = src.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, name: str, mode: str = "complete"):
    """Drains what the stream's source has into an in-memory table and stops."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
