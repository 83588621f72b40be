"""Consumption views over the gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MORTALITY_ALERT_PCT = 10.0


def last_months(monthly: DataFrame, n: int = 6) -> DataFrame:
    return monthly.orderBy(F.desc("ano_mes")).limit(n)


def top_states(states: DataFrame, n: int = 10) -> DataFrame:
    return states.filter(F.col("ranking_casos") <= n)


def mortality_alerts(states: DataFrame, limit_pct: float = MORTALITY_ALERT_PCT) -> DataFrame:
    return states.filter(F.col("taxa_mortalidade") > limit_pct)


def current_summary(history: DataFrame, date: str = "data_snapshot") -> DataFrame:
    """KPI rows of the latest snapshot."""
    latest = history.agg(F.max(date).alias(date))
    return history.join(latest, date, "left_semi")


def dashboard(kpis: DataFrame, monthly: DataFrame) -> DataFrame:
    """KPI rows, each beside the newest month. Both sides are aggregates: 12 rows and one row."""
    newest = last_months(monthly, 1).select(
        F.lit(True).alias("_one"),
        F.col("ano_mes").alias("ultimo_mes"),
        F.col("total_casos").alias("casos_ultimo_mes"),
        F.col("taxa_crescimento").alias("crescimento_ultimo_mes"),
    )
    return kpis.withColumn("_one", F.lit(True)).join(newest, "_one").drop("_one")


def create_views(kpi_history: DataFrame, monthly: DataFrame, states: DataFrame, date: str = "data_snapshot") -> list[str]:
    """Register the five views over the gold tables: KPI snapshots, months and states."""
    current = current_summary(kpi_history, date)
    views = {
        "vw_dashboard_principal": dashboard(current.drop(date), monthly),
        "vw_metricas_ultimos_6_meses": last_months(monthly, 6),
        "vw_top10_ufs": top_states(states, 10),
        "vw_alertas_mortalidade": mortality_alerts(states),
        "vw_resumo_geral_atual": current,
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
