"""Findings per event-time window (§2.9): watermark, late rows, append mode.

The scan is the batch scan; its rows keep the event time, are counted per window and type, and a window is written
once, when the watermark (the newest event time seen, less the allowed delay) has passed its end.  A row that comes late
counts as long as its window is open, and is left out after that.  State: one row per open window and type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import scan


def windowed_findings(stream: DataFrame, time_col: str, text_col: str = "text", width: str = "1 hour",
                      delay: str = "1 day", **scan_kw) -> DataFrame:
    """window_start, window_end, data_type, findings."""
    timed = stream.select(F.col(time_col).cast("timestamp").alias("event_time"), F.col(text_col).alias("__said"))
    found = scan(timed.withWatermark("event_time", delay), "__said", ["event_time"], **scan_kw)
    counts = found.groupBy(F.window("event_time", width).alias("w"), "data_type").agg(F.count(F.lit(1)).alias("findings"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "data_type", "findings")
