"""Session and sliding windows of streams under a watermark.

A window is told once, when the watermark has passed its end; then its state goes. Rows that come after that are
dropped. How late a row may be is ``lateness``; a window stays in state for its own length and that time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, gap: str, lateness: str = "2 hours") -> DataFrame:
    """Append stream of closed sessions (key, opened, closed, events): no silence in them is longer than ``gap``.

    ``closed`` is the time of the last event; events have the event time ``ts``. Null keys have sessions of their own.
    """
    inside = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), key)
    return inside.agg(F.count("*").alias("events"), F.min("ts").alias("opened"), F.max("ts").alias("closed")).select(key, "opened", "closed", "events")


def sliding(events: DataFrame, key: str, width: str, step: str, lateness: str = "10 minutes") -> DataFrame:
    """Append stream of events by key in every window of ``width`` that starts at a multiple of ``step``: (key, start, events, newest)."""
    inside = events.withWatermark("ts", lateness).groupBy(F.window("ts", width, step).alias("w"), key)
    return inside.agg(F.count("*").alias("events"), F.max("ts").alias("newest")).select(key, F.col("w.start").alias("start"), "events", "newest")
