"""Rankings, shares, moving means, trend and peaks over aggregated series.

A window without a partition key runs in one task, so these take aggregated rows: one per month,
day, state or group. Series of many keys are partitioned by the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from episurv.functions.columns import rate, thresholds

# Trend labels and thresholds.
RISING, FALLING, STABLE, TOO_SHORT = "crescente", "decrescente", "estável", "insufficient_data"
TREND_SHARE = 0.6
PEAK_THRESHOLD = 0.1

# Report bands per rate.
GROWTH_BANDS = [(10, "crescimento_significativo"), (0, "crescimento_moderado"), (None, "estabilizacao_ou_reducao")]
MORTALITY_BANDS = [(10, "alta"), (5, "moderada"), (None, "controlada")]
ICU_BANDS = [(70, "critica"), (50, "monitoramento"), (None, "controlavel")]
NO_DATA = "dados_insuficientes"
VACCINATION_BANDS = [(70, "satisfatoria"), (50, "em_expansao"), (None, "abaixo_do_ideal")]


def ranked(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """Position by value, largest first; the tie key makes it repeatable."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(value), tie)))


def grand_total(df: DataFrame, value: str) -> Column:
    """Sum over all rows as a scalar subquery; the rows are neither moved nor aggregated again."""
    return df.select(F.sum(value)).scalar()


def with_share(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "percentual", digits: int = 2) -> DataFrame:
    """Share of the sum over all rows, or over the rows of a group."""
    total = F.sum(value).over(Window.partitionBy(*by)) if by else grand_total(df, value)
    return df.withColumn(name, rate(F.col(value), total, digits))


def _ordered(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def strict_moving_mean(
    df: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 7, name: str = "media_movel"
) -> DataFrame:
    """Mean of the last `window` rows, NULL before there are that many.

    A series shorter than the window is returned as it is.
    """
    w = _ordered(keys, order)
    position = F.row_number().over(w)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    mean = F.avg(value).over(w.rowsBetween(1 - window, 0))
    return df.withColumn(
        name, F.when(size < window, F.col(value).cast("double")).when(position >= window, mean)
    )


def trend(df: DataFrame, keys: Sequence[str], order: str, value: str, share: float = TREND_SHARE) -> DataFrame:
    """Direction of each series by the share of its rising and falling steps."""
    step = F.signum((F.col(value) - F.lag(value).over(_ordered(keys, order))).cast("double"))
    up, down, steps = (F.count_if(F.col("_step") == 1), F.count_if(F.col("_step") == -1), F.count("_step"))
    label = (
        F.when(steps == 0, TOO_SHORT)
        .when(up > steps * F.lit(share), RISING)
        .when(down > steps * F.lit(share), FALLING)
        .otherwise(STABLE)
    )
    return df.withColumn("_step", step).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pontos"), up.alias("altas"), down.alias("quedas"), label.alias("tendencia")
    )


def first_to_last_growth(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Change in % from the first to the last point; 0 for a zero start or a single point."""
    first, last = F.min_by(value, order), F.max_by(value, order)
    change = F.try_divide((last - first).cast("double"), first.cast("double")) * F.lit(100.0)
    return df.groupBy(*keys).agg(
        first.alias("primeiro"),
        last.alias("ultimo"),
        F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(F.coalesce(change, F.lit(0.0))).alias("crescimento_pct"),
    )


def peaks(df: DataFrame, keys: Sequence[str], order: str, value: str, threshold: float = PEAK_THRESHOLD) -> DataFrame:
    """Points above both neighbours and near the maximum of their series."""
    w = _ordered(keys, order)
    return (
        df.withColumns(
            {
                "posicao": F.row_number().over(w) - 1,
                "_before": F.lag(value).over(w),
                "_after": F.lead(value).over(w),
                "_max": F.max(value).over(Window.partitionBy(*keys)),
            }
        )
        .filter(
            (F.col(value) > F.col("_before"))
            & (F.col(value) > F.col("_after"))
            & (F.col(value) > F.col("_max") * F.lit(1 - threshold))
        )
        .drop("_before", "_after", "_max")
    )


def rate_band(value: str, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the first bound the value exceeds; a missing value is insufficient data."""
    steps = [(F.col(value) > bound, label) for bound, label in bands if bound is not None]
    return F.coalesce(thresholds(F.col(value), steps, bands[-1][1]), F.lit(NO_DATA))


def latest_with_bands(monthly: DataFrame, order: str = "ano_mes") -> DataFrame:
    """The newest month beside the growth of the month before, with a band per rate."""
    return (
        monthly.withColumn("crescimento_anterior", F.lag("taxa_crescimento").over(Window.orderBy(order)))
        .orderBy(F.desc(order))
        .limit(1)
        .select(
            order, "taxa_crescimento", "crescimento_anterior", "total_casos", "taxa_mortalidade", "taxa_uti", "taxa_vacinacao",
            rate_band("taxa_crescimento", GROWTH_BANDS).alias("faixa_crescimento"),
            rate_band("taxa_mortalidade", MORTALITY_BANDS).alias("faixa_mortalidade"),
            rate_band("taxa_uti", ICU_BANDS).alias("faixa_uti"),
            rate_band("taxa_vacinacao", VACCINATION_BANDS).alias("faixa_vacinacao"),
        )
    )
