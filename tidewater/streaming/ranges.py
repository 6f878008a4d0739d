"""Structured Streaming on live readings: time in range by day, and episodes as sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewater.functions.numeric import percent
from tidewater.operators.glucose import HIGH, LOW


def _event_time(readings: DataFrame) -> DataFrame:
    """Streams need an instant: a local time without zone is read as if it were UTC, so that windows
    of a day stay those of the wall clock."""
    if not readings.isStreaming or dict(readings.dtypes)["t"] != "timestamp_ntz":
        return readings
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return readings.withColumn("t", F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("t"))))


def daily_time_in_range(readings: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """series, start, n, tir, tbr, tar by tumbling window of a stream (or table) of series, t, g;
    readings later than the watermark are left out."""
    g = F.col("g")
    out = _event_time(readings).withWatermark("t", late).groupBy("series", F.window("t", window)).agg(
        F.count("*").alias("n"), percent(g.between(LOW, HIGH)).alias("tir_70_180_pct"), percent(g < LOW).alias("tbr_lt70_pct"), percent(g > HIGH).alias("tar_gt180_pct")
    )
    return out.select("series", F.col("window.start").alias("start"), "n", "tir_70_180_pct", "tbr_lt70_pct", "tar_gt180_pct")


def low_sessions(readings: DataFrame, gap: str = "15 minutes", late: str = "1 hour", at_least: int = 3) -> DataFrame:
    """Sessions of low readings without a gap, with enough readings to be an episode."""
    low = _event_time(readings).where(F.col("g") < LOW).withWatermark("t", late)
    out = low.groupBy("series", F.session_window("t", gap)).agg(F.count("*").alias("n"), F.min("g").alias("lowest"))
    return out.where(F.col("n") >= at_least).select("series", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "lowest")
