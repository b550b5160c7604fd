"""Streams: replayed decisions that count once, and a latency monitor over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decision_stream(spark: SparkSession, folder: str, schema: str, late: str = "1 hour") -> DataFrame:
    """Decisions from JSON lines that arrive in a folder, each decision_id once while its time is within the watermark."""
    rows = spark.readStream.schema(schema).option("lineSep", "\n").json(folder)
    return rows.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["decision_id"])


def latency_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, mean, most) by window of event time; works on a stream and on a table."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    g = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "mean", "most")
