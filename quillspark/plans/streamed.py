"""Streaming queries, run over the events table as a bounded stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.plans.registry import query
from quillspark.shared import checkpoint_dir, table
from quillspark.streaming import changes


@query()
def stream_debounce(spark, sf_dir):
    """Keyed state over a file stream; the result is what an exactly-once sink holds at the end."""
    at = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    # Files arrive in the order of their events, a quarter of the time at once: however many files
    # a quarter has, the stream takes them as one batch, as their events aren't in order among them.
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    quarter = F.least(F.lit(3), F.floor(4 * (F.col("ts").cast("double") - F.lit(first).cast("double")) / F.greatest(F.lit(1.0), F.lit(last).cast("double") - F.lit(first).cast("double"))))
    for i in range(4):
        events.where(quarter == i).write.mode("append").parquet(f"{at}/in")
        changes.debounce_into(changes.read_events(spark, f"{at}/in", files=None), f"{at}/out", f"{at}/state", "user_id", 86400.0).awaitTermination()
    return changes.passed_on(spark, f"{at}/out")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    """An extension: event-time windows; on a stream the same plan takes a watermark."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    w = e.withWatermark("at", "1 day").groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")
