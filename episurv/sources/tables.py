"""Tables at rest: writes, logs, snapshots, layout, profile and the ledger of runs.

A target is a path in the shared folder, or a table name with an optional path.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession, Window
from pyspark.sql import functions as F

from episurv.operators.rates import rows
from episurv.operators.typing import pad_to_schema


def _is_path(target: str) -> bool:
    return "/" in target


def _save(writer: DataFrameWriter, target: str) -> None:
    if _is_path(target):
        writer.parquet(target)
    else:
        writer.format("parquet").saveAsTable(target)


def read_table(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target) if _is_path(target) else spark.table(target)


def write_table(df: DataFrame, target: str, mode: str = "overwrite") -> None:
    """The whole table anew, schema included; running it again gives the same table."""
    _save(df.write.mode(mode).option("partitionOverwriteMode", "static"), target)


def write_partitioned(df: DataFrame, target: str, cols: Sequence[str], replace_all: bool = False) -> None:
    """One folder per value; a re-run replaces the partitions it writes.

    The rebalance hint lets AQE size the files and split a value that holds many rows over
    several tasks.
    """
    mode = "static" if replace_all else "dynamic"
    writer = df.hint("rebalance", *cols).write.mode("overwrite").option("partitionOverwriteMode", mode)
    _save(writer.partitionBy(*cols), target)


def cluster_layout(
    df: DataFrame, target: str, partition_cols: Sequence[str], keys: Sequence[str], files: int | None = None, name: str | None = None
) -> None:
    """Rows near in the keys share files, so readers skip files by their min and max.

    With a name, the result becomes an external table of the catalog and its statistics are computed.

    Ranges are cut by sampled key values, partition columns first, so a large partition spans
    several tasks and each task writes to few folders.
    """
    order = [*partition_cols, *keys]
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    writer = ranged.sortWithinPartitions(*order).write.mode("overwrite").partitionBy(*partition_cols)
    if name is None:
        _save(writer, target)
    else:
        writer.format("parquet").option("path", target).saveAsTable(name)
        analyze(df.sparkSession, name)


def analyze(spark: SparkSession, name: str) -> None:
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")


def reconcile_write(
    written: DataFrame,
    expected_rows: int,
    expected_columns: int,
    years: Sequence[int],
    metadata: Sequence[str] = ("ANO_DADOS", "_ingested_at", "_source_file"),
) -> DataFrame:
    """Row count, column count, metadata columns and years of a written table, from one aggregate."""
    counted = written.agg(rows().alias("_rows"), F.count_distinct("ANO_DADOS").alias("_years"))

    def check(name, found, expected):
        return F.struct(
            F.lit(name).alias("verificacao"), found.cast("bigint").alias("encontrado"),
            F.lit(expected).cast("bigint").alias("esperado"), (found == expected).alias("ok"),
        )

    checks = F.array(
        check("row_count_match", F.col("_rows"), expected_rows),
        check("columns_count", F.lit(len(written.columns)), expected_columns),
        check("has_metadata", F.lit(sum(c in written.columns for c in metadata)), len(metadata)),
        check("all_years_present", F.col("_years"), len(years)),
    )
    return counted.select(F.inline(checks))


def append_log(df: DataFrame, target: str, schema: Mapping[str, str] | None = None) -> None:
    """Append-only log; with a schema every run writes the same columns and types."""
    fixed = df if schema is None else pad_to_schema(df, schema)
    _save(fixed.write.mode("append"), target)


def append_snapshot(df: DataFrame, target: str, snapshot: str | None = None) -> None:
    """Add today's rows to the history; the first run creates it."""
    date = F.current_date() if snapshot is None else F.to_date(F.lit(snapshot))
    _save(df.withColumn("data_snapshot", date).write.mode("append"), target)


def read_snapshots(spark: SparkSession, target: str) -> DataFrame:
    """The history; columns added by later snapshots are NULL in earlier ones."""
    return spark.read.option("mergeSchema", "true").parquet(target) if _is_path(target) else spark.table(target)


def write_embeddings(df: DataFrame, target: str, recreate: bool = False, by: str = "semantic_type") -> int:
    """Append to or replace the search table, one folder per type in both modes; rows in the table.

    A type with many rows is split over tasks by the rebalance hint.
    """
    writer = df.hint("rebalance", by).write.mode("overwrite" if recreate else "append")
    _save(writer.option("partitionOverwriteMode", "static").partitionBy(by), target)
    return read_table(df.sparkSession, target).count()


def table_profile(spark: SparkSession, name: str, first: int = 10) -> DataFrame:
    """Columns, table properties and the first partitions of a catalog table as rows."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").select(
        F.lit("describe").alias("secao"), F.col("col_name").alias("nome"), F.col("data_type").alias("valor")
    )
    partition_cols = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    if not partition_cols:
        return described
    parts = spark.sql(f"SHOW PARTITIONS {name}")
    count = parts.agg(
        F.lit("partitions").alias("secao"), F.lit("count").alias("nome"), rows().cast("string").alias("valor")
    )
    head = parts.orderBy("partition").limit(first).select(
        F.lit("partition").alias("secao"), F.col("partition").alias("nome"), F.lit(None).cast("string").alias("valor")
    )
    return described.unionByName(count).unionByName(head)


def write_with_ledger(df: DataFrame, target: str, ledger: str, operation: str, process_id: str | None = None) -> int:
    """Write a table and append one ledger row; the rows are counted by the write itself."""
    spark = df.sparkSession
    watch = Observation()
    observed = df.observe(watch, rows().alias("num_rows"))
    write_table(observed, target)
    written = int(watch.get["num_rows"])
    append_ledger(spark, ledger, operation, target, written, process_id)
    return written


def append_ledger(spark: SparkSession, ledger: str, operation: str, target: str, num_rows: int, process_id: str | None = None) -> None:
    """One row per write. Writers only append, so they need not agree on a number."""
    row = spark.range(1).select(
        F.current_timestamp().alias("timestamp"),
        F.lit(operation).alias("operation"),
        F.lit(target).alias("target"),
        F.lit(num_rows).cast("bigint").alias("num_rows"),
        F.lit(process_id or uuid.uuid4().hex).alias("process_id"),
    )
    append_log(row, ledger)


def read_ledger(spark: SparkSession, ledger: str, target: str | None = None) -> DataFrame:
    """The writes with their version, numbered from 0 in time order."""
    found = read_table(spark, ledger)
    mine = found if target is None else found.filter(F.col("target") == target)
    version = F.row_number().over(Window.orderBy("timestamp", "process_id", "target")) - 1
    return mine.withColumn("version", version.cast("bigint"))


def ingestion_stats(bronze: DataFrame, name: str, year: str = "ANO_DADOS") -> DataFrame:
    """One row that describes an ingest: rows, columns and the years found."""
    return bronze.agg(
        F.lit(name).alias("table"),
        rows().alias("total_rows"),
        F.lit(len(bronze.columns)).alias("total_columns"),
        F.array_sort(F.collect_set(year)).alias("years_processed"),
    ).withColumns({"timestamp": F.current_timestamp(), "validation_passed": F.col("total_rows") > 0})


def write_stats_json(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("append").json(path)


def widen_column(spark: SparkSession, source: str, target: str, column: str, to: str = "string") -> None:
    """Rewrite a table with one column in a wider type."""
    df = read_table(spark, source)
    write_table(df.withColumn(column, F.col(column).cast(to)), target)


# Times in exports keep their microseconds; Spark's own text stops at milliseconds.
EXPORT_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def export_logs(log: DataFrame, path: str, kind: str = "json") -> None:
    """Log rows as JSON lines, or as CSV with nested values as JSON text; read them with the options EXPORT_TIMES."""
    if kind == "json":
        log.write.mode("overwrite").options(**EXPORT_TIMES).json(path)
        return
    flat = [
        (F.to_json(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f.name)).alias(f.name)
        for f in log.schema.fields
    ]
    log.select(*flat).write.mode("overwrite").options(header="true", escape='"', **EXPORT_TIMES).csv(path)
