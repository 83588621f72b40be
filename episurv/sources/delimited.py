"""Delimited notification files: scan as text, trial run, ingest metadata, union of years."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File format and the name pattern of a year's files.
OPTIONS = {
    "header": "true",
    "sep": ";",
    "encoding": "ISO-8859-1",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "mode": "PERMISSIVE",
    "inferSchema": "false",
}
YEAR_PATTERN = "INFLUD{yy}-*.csv"


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def scan_delimited(spark: SparkSession, path: str, columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    """Every field as text. Without column names they come from the header line.

    Records may span lines, so a file is read by one task and the files are the unit of
    parallelism. Pass `multiLine="false"` for files known to hold one record per line: Spark then
    splits large files.
    """
    reader = spark.read.options(**{**OPTIONS, **options})
    return reader.csv(path, schema=None if columns is None else text_schema(columns))


def year_glob(directory: str, year: int, pattern: str = YEAR_PATTERN) -> str:
    return f"{directory.rstrip('/')}/{pattern.format(yy=f'{year % 100:02d}')}"


def scan_year(spark: SparkSession, directory: str, year: int, pattern: str = YEAR_PATTERN, **options: str) -> DataFrame:
    """The files of one year, chosen by name."""
    return scan_delimited(spark, year_glob(directory, year, pattern), **options)


def list_sources(spark: SparkSession, directory: str) -> DataFrame:
    """Names and sizes of the `.csv` sources; the file contents are not read.

    A source is a file, or a folder of parts that ends in `.csv`.
    """
    files = (
        spark.read.format("binaryFile")
        .options(pathGlobFilter="*.csv", recursiveFileLookup="true")
        .load(directory)
        .select("path", "length")
    )
    name = F.regexp_extract("path", r"([^/]+\.csv)(/part-[^/]*)?$", 1)
    return files.groupBy(name.alias("nome")).agg(
        F.count(F.lit(1)).alias("arquivos"), F.sum("length").alias("bytes")
    )


def require_sources(sources: DataFrame) -> DataFrame:
    if sources.isEmpty():
        raise FileNotFoundError("no .csv source found")
    return sources


def dry_run(
    spark: SparkSession, directory: str, years: Sequence[int], pattern: str = YEAR_PATTERN, **options: str
) -> DataFrame:
    """Rows, columns and error per year, and the total; all years in one job.

    Opening a year reads its header only. A year that cannot be opened becomes a row with its
    error instead of ending the run.
    """
    parts = []
    for year in years:
        try:
            source = scan_year(spark, directory, year, pattern, **options)
            row = source.agg(F.count(F.lit(1)).alias("linhas"))
            columns, error = F.lit(len(source.columns)), F.lit(None).cast("string")
        except PySparkException as e:
            row = spark.range(1).select(F.lit(0).cast("bigint").alias("linhas"))
            columns, error = F.lit(0), F.lit(e.getCondition() or type(e).__name__)
        parts.append(row.select(F.lit(year).alias("ano"), "linhas", columns.alias("colunas"), error.alias("erro")))
    everything = Window.partitionBy()
    return reduce(DataFrame.unionByName, parts).withColumns(
        {"total_linhas": F.sum("linhas").over(everything), "ok": F.col("erro").isNull()}
    )


def require_dry_run(report: DataFrame) -> None:
    failed = [f"{r.ano}: {r.erro}" for r in report.filter(~F.col("ok")).collect()]
    if failed:
        raise ValueError("sources failed: " + "; ".join(failed))


def add_ingest_metadata(df: DataFrame, year: int) -> DataFrame:
    """Source year, load time and the file each record came from."""
    return df.withColumns(
        {
            "ANO_DADOS": F.lit(year),
            "_ingested_at": F.current_timestamp(),
            "_source_file": F.col("_metadata.file_path"),
        }
    )


def union_years(parts: Sequence[DataFrame]) -> DataFrame:
    """By name; a column that a year lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ingest(
    spark: SparkSession, directory: str, years: Sequence[int], pattern: str = YEAR_PATTERN, **options: str
) -> DataFrame:
    """The bronze table: all years as text with their ingest metadata."""
    return union_years(
        [add_ingest_metadata(scan_year(spark, directory, y, pattern, **options), y) for y in years]
    )
