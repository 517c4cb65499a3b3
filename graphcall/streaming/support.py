"""Read supports that arrive over time: windowed counts with late data, exact over restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """``events`` with a watermark; streams need times with a zone, the session's where they have none."""
    if events.isStreaming:
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late)


def windowed_counts(events: DataFrame, *, time: str = "ts", keys: tuple[str, ...] = ("event_type",), width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window; rows later than the watermark are dropped. Works on batches and streams."""
    rows = _timed(events, time, late).groupBy(F.window(time, width), *keys)
    out = rows.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def distinct_fragments(reads: DataFrame, *, time: str = "ts", id_col: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Reads without repeats of the same id within the watermark."""
    return _timed(reads, time, late).dropDuplicatesWithinWatermark([id_col])


def sessions(events: DataFrame, *, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Bursts of a key's rows with no pause over ``gap``."""
    out = _timed(events, time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
