"""Windowed aggregation, dedupe and enrichment of event streams; the same functions serve batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str | None = None) -> DataFrame:
    """ts as a timestamp (a watermark takes no other), with a watermark on streams if a delay is given."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", delay) if delay and out.isStreaming else out


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    w = timed(events, delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    w = timed(events, delay).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id", 0.01).alias("users"))
    return w.select(F.col("window.start").alias("start"), "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    s = timed(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def deduped(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    out = timed(events, delay)
    return out.dropDuplicatesWithinWatermark(["event_id"]) if out.isStreaming else out.dropDuplicates(["event_id"])


def enriched(events: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """A stream joined with a table that does not change."""
    return timed(events).join(static, on, "left")


def upsert_sink(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Writes micro-batches so that a batch that is run again replaces what it wrote: idempotent by batch number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
