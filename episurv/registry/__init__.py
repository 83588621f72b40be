"""Every operator as a runnable query on the test tables, with its SQL twin."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Dates, timestamps and nested values as text, so both engines print them alike."""

    def plain(field: T.StructField):
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL text that must give the same rows."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load() -> None:
    """Import the query modules once; each fills the two tables."""
    from episurv.registry import (  # noqa: F401
        cases_queries,
        gold_queries,
        explore_queries,
        quality_queries,
        audit_queries,
        text_queries,
        io_queries,
        function_queries,
        layout_queries,
    )
