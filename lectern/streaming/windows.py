"""Event-time windows; the same functions take streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str = "ts", width: str = "1 hour", key: str = "event_type", value: str = "value", delay: str = "1 hour") -> DataFrame:
    """(window_start, key, n, total) of each window of ``width``."""
    per = _late(df, ts, delay).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return per.select(F.col("window.start").alias("window_start"), key, "n", "total")


def sliding(df: DataFrame, ts: str = "ts", width: str = "1 hour", step: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    per = _late(df, ts, delay).groupBy(F.window(ts, width, step)).agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").alias("window_start"), "n")


def sessions(df: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(key, session_start, n) of runs of events with pauses below ``gap``."""
    per = _late(df, ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return per.select(key, F.col("session_window.start").alias("session_start"), "n")


def deduplicated(df: DataFrame, key: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Rows of a key once; on a stream within the delay of late rows."""
    return _late(df, ts, delay).dropDuplicatesWithinWatermark(key) if df.isStreaming else df.dropDuplicates(key)
