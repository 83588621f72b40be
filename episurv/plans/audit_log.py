"""Audit log derived from the event table: a user is a session, a value is an elapsed time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episurv.plans.cases import table


def as_audit_log(events: DataFrame) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    status = (
        F.when((kind == "error") & (value > 60), "critical")
        .when(kind == "error", "error")
        .when((kind == "click") & (value < 2), "warning")
        .when(kind == "view", "info")
        .otherwise("success")
    )
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("session_id"),
        F.col("ts").alias("timestamp"),
        "event_type",
        status.alias("status"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("details"),
        F.col("value").alias("elapsed_seconds"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_audit_log(table(spark, sf_dir, "events"))
