"""Audit events as a stream: every micro-batch leaves its own counts, and counts of all batches add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episurv.operators.audit import ERRORS, per_type_measures, summarise_sessions
from episurv.streaming.batches import BATCH, run_available

KEYS = ["date", "session_id", "event_type", "status"]


def append_events(log: DataFrame, target: str, checkpoint: str) -> None:
    """The events themselves, appended by date."""
    query = (
        log.withColumn("date", F.to_date("timestamp"))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("date")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def daily_partials(log: DataFrame) -> DataFrame:
    """Counts and times per day, session, type and status of the events at hand."""
    stamped = log.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return stamped.withColumn("date", F.to_date("timestamp")).groupBy(*KEYS).agg(*per_type_measures())


def run_partials(log: DataFrame, target: str, checkpoint: str) -> None:
    """One folder of counts for each micro-batch. There is no state and no watermark, so events may come in any order
    and as late as they like; a batch that is run again replaces its folder."""
    run_available(log, target, checkpoint, of_batch=daily_partials)


def current_partials(spark: SparkSession, target: str) -> DataFrame:
    """The counts of all batches; a key may have several rows, which its readers add up."""
    return spark.read.parquet(target).drop(BATCH)


def session_summary(partials: DataFrame) -> DataFrame:
    return summarise_sessions(partials)


def error_trend(partials: DataFrame) -> DataFrame:
    return (
        partials.filter(F.col("status").isin(*ERRORS))
        .groupBy("date", "event_type")
        .agg(F.sum("_n").alias("error_count"))
    )
