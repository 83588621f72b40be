"""Layouts that let readers skip: space-filling order, bloom filters, buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episurv.functions.columns import as_col

# Bits of a key in the order; rows that its ranges are cut by, about.
BITS, SAMPLE = 8, 10_000


def range_number(key: str | Column, bounds: Sequence) -> Column:
    """How many of the ascending bounds the key has reached: a binary search as an expression. NULL reaches none."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    values = F.array(*[F.lit(b) for b in bounds])

    def step(low: Column, size: Column) -> Column:
        return F.when(F.get(values, low + size - 1) <= as_col(key), low + size).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step) if bounds else F.lit(0)


def morton_code(numbers: Sequence[Column], bits: int = BITS) -> Column:
    """The bits of whole numbers below 2**bits in turn, highest first: numbers near in all keys are near in the code."""
    code = F.lit(0).cast("bigint")
    for bit in range(bits):
        for n, number in enumerate(reversed(numbers)):
            one = F.shiftright(number, bit).bitwiseAND(F.lit(1)).cast("bigint")
            code = code.bitwiseOR(F.shiftleft(one, bit * len(numbers) + n))
    return code


def key_bounds(df: DataFrame, keys: Sequence[str], bits: int = BITS, sample: int = SAMPLE) -> dict[str, list]:
    """For each key up to 2**bits - 1 values that cut its rows into ranges of like size, from a sample of about `sample` rows."""
    total = df.count()
    rows = df.select(*keys).sample(min(1.0, sample / max(1, total)), seed=11).collect()
    out = {}
    for key in keys:
        values = sorted(r[key] for r in rows if r[key] is not None)
        cuts = {values[len(values) * i >> bits] for i in range(1, 1 << bits)} if values else set()
        out[key] = sorted(cuts)
    return out


def morton_layout(
    df: DataFrame,
    target: str,
    partition_cols: Sequence[str],
    keys: Sequence[str],
    files: int | None = None,
    bits: int = BITS,
) -> None:
    """Write a table whose files are small boxes in all keys: rows are dealt and sorted by a Morton code of the keys, within the
    partition columns. A predicate on any of the keys skips files, where an order by the keys in turn serves the first alone.

    Keys are cut into ranges of like size first, so dates, numbers and text count alike and skewed values do not fill one file's
    range of codes. The sample only shapes the files; rows are the same with any.
    """
    bounds = key_bounds(df, keys, bits)
    code = "_" * (1 + max(map(len, df.columns))) + "code"
    order = [*partition_cols, code]
    # A key of few values has few ranges; they are spread over all its bits, so that it takes turns with the others from the first on.
    spread = [(range_number(k, bounds[k]) * (1 << bits) / (len(bounds[k]) + 1)).cast("int") for k in keys]
    coded = df.withColumn(code, morton_code(spread, bits))
    ranged = coded.repartitionByRange(files, *order) if files else coded.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).drop(code).write.mode("overwrite").partitionBy(*partition_cols).parquet(target)


def file_ranges(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """One row per file: rows, least and greatest value of each key."""
    ends = [f(k).alias(f"{name}_{k}") for k in keys for name, f in (("min", F.min), ("max", F.max))]
    table = spark.read.parquet(target).select(*keys, F.col("_metadata.file_path").alias("file"))
    return table.groupBy("file").agg(F.count("*").alias("rows"), *ends)


def write_lookup_log(df: DataFrame, target: str, lookups: Mapping[str, int], mode: str = "append") -> None:
    """Append log rows with a bloom filter on each lookup column, given how many distinct values a row group may hold.

    A lookup of one id reads the row groups whose filter has it; ids are spread over all files, so their ranges skip nothing.
    """
    writer = df.write.mode(mode)
    for column, distinct in lookups.items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct))
    writer.parquet(target)


def find_rows(spark: SparkSession, target: str, column: str, values: Sequence) -> DataFrame:
    """The rows with one of these values; equality is what a bloom filter answers."""
    test = F.col(column) == values[0] if len(values) == 1 else F.col(column).isin(*values)
    return spark.read.parquet(target).filter(test)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """An external catalog table in `buckets` parts by the hash of the key, each sorted by it. Two tables with the same key and number
    of buckets join without an exchange. Rows are dealt to their buckets first, so that each bucket is one file."""
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
