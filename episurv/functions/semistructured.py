"""Details of unknown shape as VARIANT: parsed once, read by path, malformed text kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episurv.functions.columns import as_col


def parsed(text: str | Column) -> Column:
    """The JSON text as a VARIANT; NULL where it is no JSON."""
    return F.try_parse_json(as_col(text))


def detail(variant: str | Column, path: str, kind: str = "string") -> Column:
    """The value at a path (`$.a.b[0]`); NULL where it is absent or cannot be read as the kind."""
    return F.try_variant_get(as_col(variant), path, kind)


def with_details(df: DataFrame, text: str, into: str = "details", malformed: str = "malformed") -> DataFrame:
    """Adds the VARIANT and the text that could not be parsed: NULL where it could, or where there was none."""
    variant = parsed(text)
    return df.withColumns({into: variant, malformed: F.when(variant.isNull(), F.col(text))})


def detail_kinds(df: DataFrame, variant: str) -> DataFrame:
    """(kind, rows): the schemas of the values, as they are found, most frequent first."""
    return df.groupBy(F.schema_of_variant(variant).alias("kind")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "kind")
