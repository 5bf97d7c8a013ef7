"""The streaming form of gap sessionization: events of a key belong together while gaps stay within a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n) of the sessions of a stream or table; state is dropped once the watermark has passed."""
    out = events.withWatermark(time, late) if events.isStreaming else events
    return out.groupBy(F.col(key), F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
