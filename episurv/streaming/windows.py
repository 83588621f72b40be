"""Event-time windows over the audit log: counts that are final when the watermark has passed their window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_windows(
    log: DataFrame, delay: str, size: str = "1 day", ts: str = "timestamp", event_type: str = "event_type", status: str = "status"
) -> DataFrame:
    """Errors per window and type (date, event_type, error_count), each window once, in append mode.

    State holds the open windows and types only, whatever number of events they stand for. An event whose window the
    watermark has passed is dropped; run the stream with `run_available(..., allow_late=False)`, which counts those and raises.
    The last windows are written when later events of any status move the watermark past them, so errors are counted, not filtered:
    windows of a type without an error are written with none and left out by `closed_windows`.
    """
    stamped = log.select(F.col(ts).cast("timestamp").alias("at"), F.col(event_type).alias("event_type"), status).withWatermark("at", delay)
    wrong = F.count_if(F.col(status).isin("error", "critical"))
    counted = stamped.groupBy(F.window("at", size).alias("span"), "event_type").agg(wrong.alias("error_count"))
    return counted.select(F.col("span.start").alias("start"), "event_type", "error_count")


def closed_windows(written: DataFrame) -> DataFrame:
    """Windows with errors, by date."""
    return written.filter("error_count > 0").select(F.to_date("start").alias("date"), "event_type", "error_count")
