"""Usage by stage over event time, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_by_window(calls: DataFrame, time_col: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls and durations by stage and window; the same for batch and stream."""
    source = calls.withWatermark(time_col, late) if calls.isStreaming else calls
    grouped = source.groupBy(F.window(time_col, window).alias("w"), "stage").agg(F.count("*").alias("calls"), F.sum("duration_ms").alias("duration_ms"))
    return grouped.select(F.col("w.start").alias("window_start"), "stage", "calls", "duration_ms")


def write(calls: DataFrame, folder: str, **options: str):
    """Append each window's usage to Parquet once the watermark has passed it; its state is dropped then.

    The folder also holds the stream's checkpoint, so it must be one that all executors share.
    """
    sink = usage_by_window(calls).writeStream.outputMode("append").format("parquet")
    return sink.option("path", f"{folder.rstrip('/')}/windows").option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").options(**options)


def start(calls: DataFrame, name: str, **options: str):
    """Run the windowed usage of a stream into a memory table: for tests and dashboards."""
    return usage_by_window(calls).writeStream.outputMode("complete").format("memory").queryName(name).options(**options).start()
