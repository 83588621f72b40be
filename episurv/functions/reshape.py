"""Rows made of columns, and columns that are computed once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measures_to_rows(df: DataFrame, entries: Sequence[tuple[Mapping[str, object], Mapping[str, Column]]]) -> DataFrame:
    """Compute the measures of all entries in one `agg` and return one row per entry.

    An entry is (constant columns, measures); every entry names the same columns. However many
    fields are checked, the input is read once and each task ships one row.
    """
    aggs, structs = [], []
    for i, (constants, measures) in enumerate(entries):
        fields = [F.lit(value).alias(name) for name, value in constants.items()]
        for name, measure in measures.items():
            aggs.append(measure.alias(f"m{i}_{name}"))
            fields.append(F.col(f"m{i}_{name}").alias(name))
        structs.append(F.struct(*fields))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def with_values(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns whose expressions are evaluated once per row.

    A filter on a computed column is normally pushed below the projection that computes it, with
    the expression copied in for every mention. For costly expressions with several mentions that
    multiplies the work, and the generated method outgrows what the JVM compiles. Optimizer rules
    do not move filters through a generator, so these columns come out of one.
    """
    values = F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    added = df.select(*[c for c in df.columns if c not in columns], values)
    return added.select(*df.columns, *[c for c in columns if c not in df.columns])
