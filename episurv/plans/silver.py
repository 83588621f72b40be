"""Raw notifications to the typed, filtered, de-duplicated and featured case table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from episurv.operators.filters import apply_quality_filters
from episurv.operators.typing import add_clean_codes, add_features, add_lineage, select_available, type_cases
from episurv.plans.cases import raw_cases
from episurv.session import scratch_path


def typed_cases(raw: DataFrame) -> DataFrame:
    return add_clean_codes(type_cases(select_available(raw)))


def silver_cases(raw: DataFrame, process_id: str | None = None) -> DataFrame:
    """The silver table; lineage columns only when a process id is given."""
    cases = add_features(apply_quality_filters(typed_cases(raw)))
    return cases if process_id is None else add_lineage(cases, process_id, "silver")


def written_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver table, written once to the shared folder for several readers."""
    target = scratch_path(spark, "silver")
    silver = silver_of(spark, sf_dir)
    silver.write.parquet(target)
    return spark.read.schema(silver.schema).parquet(target)


def silver_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_cases(raw_cases(spark, sf_dir))
