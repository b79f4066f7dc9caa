"""Sessions and counts over event streams (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions by gap with a watermark. A gap of exactly the limit already splits here."""
    e = events.withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", late)
    per = e.groupBy("client_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return per.select("client_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n_events")


def stream_type_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and window of event time."""
    e = events.withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", late)
    per = e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").alias("begin"), "event_type", "n")
