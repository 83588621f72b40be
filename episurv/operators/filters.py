"""Row filters of the case table and their loss report."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episurv.functions.codes import MAX_FILTER_LOSS_PCT, UNKNOWN_BAND
from episurv.functions.columns import all_of, as_col


# --- predicates -----------------------------------------------------------------------------


def filled(cols: Sequence[str] = ("nu_notific", "dt_sin_pri", "dt_notific")) -> Column:
    return all_of(F.col(c).isNotNull() for c in cols)


def ordered_dates(
    symptom: str = "dt_sin_pri",
    notified: str = "dt_notific",
    admitted: str = "dt_interna",
    ended: str = "dt_evoluca",
) -> Column:
    """Symptoms, notification, admission and outcome in that order where present."""
    s, n, a, e = (F.col(c) for c in (symptom, notified, admitted, ended))
    return F.coalesce(s <= n, F.lit(False)) & (a.isNull() | (s <= a)) & (a.isNull() | e.isNull() | (a <= e))


def range_or_null(c: str | Column, low: float, high: float) -> Column:
    return as_col(c).isNull() | as_col(c).between(low, high)


def known_category(c: str | Column, unknown: str = UNKNOWN_BAND) -> Column:
    return as_col(c).isNotNull() & (as_col(c) != unknown)


def since_days(c: str | Column, days: int, anchor: str | Column | None = None) -> Column:
    """On or after `days` before the anchor date (today when not given)."""
    today = F.current_date() if anchor is None else (F.lit(anchor).cast("date") if isinstance(anchor, str) else anchor)
    return as_col(c) >= F.date_sub(today, days)


def in_codes(codes: Mapping[str, Sequence[str]]) -> Column:
    return all_of(F.col(c).isin(*values) for c, values in codes.items())


# --- operators ------------------------------------------------------------------------------


def quality_steps() -> list[tuple[str, Column]]:
    """The mandatory row filters in order, before de-duplication."""
    return [
        ("campos_obrigatorios", filled()),
        ("consistencia_temporal", ordered_dates()),
        ("idade_valida", range_or_null("nu_idade_n", 0, 120)),
    ]


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in the given order.

    Ties go by a hash of the whole row, so the choice does not depend on the partitioning. The
    `= 1` filter lets Spark keep one row per key and task before the shuffle, which also thins
    out a key that holds many rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*[as_col(c) for c in order], F.xxhash64(*df.columns))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def apply_quality_filters(
    df: DataFrame, key: str = "nu_notific", order: Sequence[str] = ("dt_notific", "dt_sin_pri")
) -> DataFrame:
    return first_per_key(df.filter(all_of(c for _, c in quality_steps())), key, order)


def filter_funnel(
    df: DataFrame,
    steps: Sequence[tuple[str, Column]] | None = None,
    key: str = "nu_notific",
    max_loss_pct: float = MAX_FILTER_LOSS_PCT,
) -> DataFrame:
    """Rows in, out and excluded per step, from one aggregate over the input.

    The last step is de-duplication; its result size is the number of distinct keys that passed.
    """
    steps = quality_steps() if steps is None else list(steps)
    passed = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("n0")]
    for i, (_, condition) in enumerate(steps, 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        aggs.append(F.count_if(passed).alias(f"n{i}"))
    last = len(steps) + 1
    # A distinct count moves every key: it is a narrow aggregate of its own, and the counters stay where they are.
    keys = df.filter(passed).agg(F.count_distinct(key).alias(f"n{last}")).withColumn("_one", F.lit(True))
    names = [name for name, _ in steps] + ["duplicatas"]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordem"),
                F.lit(name).alias("filtro"),
                F.col(f"n{i - 1}").alias("entrada"),
                F.col(f"n{i}").alias("saida"),
            )
            for i, name in enumerate(names, 1)
        ]
    )
    lost = F.col("entrada") - F.col("saida")
    total_loss = F.try_divide((F.col("n0") - F.col(f"n{last}")).cast("double"), F.col("n0").cast("double")) * 100.0
    return (
        df.agg(*aggs)
        .withColumn("_one", F.lit(True))
        .join(keys, "_one")
        .select("n0", f"n{last}", F.inline(rows))
        .select(
            "ordem",
            "filtro",
            "entrada",
            "saida",
            lost.alias("excluidos"),
            F.round(F.try_divide(lost * 100.0, F.col("n0").cast("double")), 2).alias("excluidos_pct"),
            F.round(total_loss, 2).alias("perda_total_pct"),
            F.coalesce(total_loss < max_loss_pct, F.lit(False)).alias("perda_aceitavel"),
        )
    )


def equality_filters(
    df: DataFrame,
    filters: Mapping[str, str],
    allowed: Sequence[str] = ("semantic_type", "source_table", "ano_mes", "uf"),
) -> DataFrame:
    """Conjunction over allowed keys; other keys are ignored, values lose special characters."""
    clean = {k: re.sub(r"[^\w\s\-]", "", str(v)).strip() for k, v in filters.items() if k in allowed}
    return df.filter(all_of(F.col(k) == v for k, v in clean.items()))
