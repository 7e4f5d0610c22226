"""Received-power readings as a stream: windows by link with late data, and the latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(readings: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, least, mean) of readings (ts, kind, value) by window; works on streams and on tables."""
    w = F.window("ts", length)
    return readings.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "kind", "n", "least", "mean")


def outages(readings: DataFrame, sensitivity: float, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(link, start, stop, n): sessions of readings (ts, link, value) under the sensitivity."""
    s = F.session_window("ts", gap)
    return readings.where(F.col("value") < sensitivity).withWatermark("ts", late).groupBy(s.alias("s"), "link").agg(F.count(F.lit(1)).alias("n")).select("link", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")
