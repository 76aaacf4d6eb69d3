"""Watermarked stream operators: late data, duplicates, sessions and windowed popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def distinct_events(events: DataFrame, delay: str, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """Each event once, as far as repeats arrive within the delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_popularity(events: DataFrame, delay: str, size: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Events per item and time window.

    The count is combined on the map side, so a hot item costs one row per task and window.
    """
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counted = events.withWatermark(ts, delay).groupBy(window.alias("w"), "item_id").agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "item_id", "n_events", "value")


def session_counts(events: DataFrame, delay: str, gap: str, ts: str = "ts") -> DataFrame:
    """Closed sessions per user. Sessions are merged inside each task first
    (spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition)."""
    grouped = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), "user_id").agg(F.count("*").alias("n_events"))
    return grouped.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")
