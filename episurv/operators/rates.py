"""The measures behind the four rates, shared by every aggregate table.

All are plain aggregate expressions over the case columns, so one `agg` computes any set of them
in one pass and Spark shares the repeated counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episurv.functions.codes import CURED, DIED, IGNORED, NO, YES
from episurv.functions.columns import rate


def rows() -> Column:
    return F.count(F.lit(1))


def deaths(outcome: str = "evolucao_clean") -> Column:
    return F.count_if(F.col(outcome) == DIED)


def cures(outcome: str = "evolucao_clean") -> Column:
    return F.count_if(F.col(outcome) == CURED)


def with_outcome(outcome: str = "evolucao_clean") -> Column:
    return F.count(F.col(outcome))


def true_count(name: str) -> Column:
    return F.count_if(F.col(name))


def with_vaccine_answer(vaccine: str = "vacina_clean") -> Column:
    return F.count_if(F.col(vaccine).isin(YES, NO))


def mortality() -> Column:
    """Died among cases whose outcome is known."""
    return rate(deaths(), with_outcome())


def icu_rate() -> Column:
    """Intensive care over admitted; the numerator is not limited to admitted cases."""
    return rate(true_count("is_uti"), true_count("is_internado"))


def vaccination() -> Column:
    return rate(true_count("is_vacinado"), with_vaccine_answer())


def mean(name: str, digits: int = 1) -> Column:
    return F.round(F.avg(name), digits)


def median(name: str) -> Column:
    """Exact interpolating median. Its buffer is a map of distinct values, so use it on small domains."""
    return F.percentile(F.col(name), 0.5)


def mean_and_median(df: DataFrame, keys: list[str], value: str, digits: int = 1) -> DataFrame:
    """Mean and exact median per group, from counts per group and value.

    The counts combine in the map tasks, so a group of many rows costs as much as its distinct
    values; no task buffers the rows of a group.
    """
    counts = df.groupBy(*keys, value).agg(rows().alias("_n"))
    v, n = F.col(value), F.col("_n")
    known = F.sum(F.when(v.isNotNull(), n)).cast("double")
    return counts.groupBy(*keys).agg(
        F.round(F.try_divide(F.sum(v * n).cast("double"), known), digits).alias("media"),
        F.percentile(v, 0.5, n).alias("mediana"),
    )


def growth(df: DataFrame, value: str, order: str, name: str = "taxa_crescimento") -> DataFrame:
    """Change in % against the previous existing row; NULL on the first row or after a zero.

    The window is global, so call it on aggregated rows only.
    """
    previous = F.lag(value).over(Window.orderBy(order))
    change = (F.col(value) - F.col("_previous")) * F.lit(100.0) / F.col("_previous")
    return (
        df.withColumn("_previous", previous)
        .withColumn(name, F.when(F.col("_previous") > 0, F.round(change, 2)))
        .drop("_previous")
    )


def strict_icu_rate(df: DataFrame, hospital: str = "HOSPITAL", icu: str = "UTI") -> DataFrame:
    """Intensive care among admitted cases with a known answer."""
    known = df.filter((F.col(hospital) == YES) & F.col(icu).isin(YES, NO))
    return known.agg(
        rows().alias("total_hospitalizados"),
        F.count_if(F.col(icu) == YES).alias("casos_uti"),
        rate(F.count_if(F.col(icu) == YES), rows()).alias("taxa_uti"),
    )


def ignored_count(name: str) -> Column:
    return F.count_if(F.col(name) == IGNORED)
