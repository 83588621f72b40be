"""Incremental copy of new and changed documents into the search table.

Each sync writes only its changes. Readers take the newest version of each key, and `compact`
folds the versions into one when they have piled up; no sync rewrites the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from episurv.streaming.batches import BATCH, file_stream, latest, run_available


def sync_index(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> None:
    """Copy what the source gained since the last sync."""
    run_available(file_stream(spark, source, schema), target, checkpoint)


def current_index(spark: SparkSession, target: str, key: str = "doc_id") -> DataFrame:
    return latest(spark, target, key)


def compact(spark: SparkSession, target: str, compacted: str, key: str = "doc_id") -> None:
    """The newest versions as a table of their own, readable like the first batch of a new index."""
    current_index(spark, target, key).write.mode("overwrite").parquet(f"{compacted}/{BATCH}=-1")
