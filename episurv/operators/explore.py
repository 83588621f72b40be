"""Exploration summaries over the case tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episurv.functions.codes import (
    AGE_BANDS,
    AGE_BANDS_COARSE,
    DIED,
    CURED,
    IGNORED,
    IGNORED_CODE_FIELDS,
    MISSING_FIELDS,
)
from episurv.functions.columns import (
    band, is_missing, ordinal, pct, rate, thresholds,
)
from episurv.functions.reshape import measures_to_rows
from episurv.operators.filters import known_category, since_days
from episurv.operators.series import grand_total
from episurv.operators.rates import deaths, mean, median, rows, with_outcome


def band_mortality(silver: DataFrame, by: str = "faixa_etaria", died: str = "is_obito") -> DataFrame:
    """Deaths over all rows of a band: an unknown outcome counts as alive."""
    share = F.avg(F.when(F.col(died), F.lit(100.0)).otherwise(F.lit(0.0)))
    return silver.filter(known_category(by)).groupBy(by).agg(
        rows().alias("casos"), F.round(share, 2).alias("taxa_mortalidade")
    )


def in_band_order(df: DataFrame, by: str = "faixa_etaria", cuts=AGE_BANDS) -> DataFrame:
    return df.orderBy(ordinal(by, [label for _, label in cuts]))


def text_summary(silver: DataFrame) -> DataFrame:
    """Headline figures as (metric, text) rows, from one aggregate."""
    entries = [
        ("Total de Registros", rows().cast("string")),
        (
            "Período",
            F.concat(F.min("dt_sin_pri").cast("string"), F.lit(" a "), F.max("dt_sin_pri").cast("string")),
        ),
        ("UFs Distintas", F.count_distinct("sg_uf").cast("string")),
        ("Idade Média", mean("nu_idade_n").cast("string")),
        ("Taxa de Óbitos Geral (%)", rate(deaths(), with_outcome()).cast("string")),
    ]
    return measures_to_rows(silver, [({"metrica": name}, {"valor": value}) for name, value in entries])


def top_categories(df: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The largest categories with their share of all rows, rows without a category included."""
    counts = df.groupBy(by).agg(rows().alias("casos"))
    return (
        counts.withColumn("percentual", rate(F.col("casos"), grand_total(counts, "casos")))
        .filter(F.col(by).isNotNull())
        .orderBy(F.desc("casos"), by)
        .limit(n)
    )


def share_among_top(df: DataFrame, by: str, n: int = 15, head: int = 5) -> DataFrame:
    """The largest categories with their share of those n, and the share held by the first few."""
    top = (
        df.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(rows().alias("casos"))
        .orderBy(F.desc("casos"), by)
        .limit(n)
    )
    everything = Window.partitionBy()
    position = F.row_number().over(Window.orderBy(F.desc("casos"), by))
    total = F.sum("casos").over(everything)
    first = F.sum(F.when(F.col("posicao") <= head, F.col("casos"))).over(everything)
    return top.withColumn("posicao", position).withColumns(
        {"percentual": rate(F.col("casos"), total), "concentracao_pct": rate(first, total)}
    )


def band_distribution(df: DataFrame, age: str, elderly: Sequence[str] = ("60-69", "70+")) -> DataFrame:
    """Cases per coarse age band with share and order, and the share of the elderly bands."""
    counts = (
        df.select(band(age, AGE_BANDS_COARSE).alias("faixa_etaria"))
        .filter(known_category("faixa_etaria"))
        .groupBy("faixa_etaria")
        .agg(rows().alias("casos"))
    )
    everything = Window.partitionBy()
    total = F.sum("casos").over(everything)
    old = F.sum(F.when(F.col("faixa_etaria").isin(*elderly), F.col("casos")).otherwise(F.lit(0))).over(everything)
    return counts.withColumns(
        {
            "ordem": ordinal("faixa_etaria", [label for _, label in AGE_BANDS_COARSE]),
            "percentual": rate(F.col("casos"), total),
            "pct_60_mais": rate(old, total),
        }
    ).orderBy("ordem")


# Completeness levels.
COMPLETENESS_LEVELS = [(1.0, "Completo (100%)"), (0.75, "Bom (75-99%)"), (0.5, "Médio (50-74%)")]
COMPLETENESS_REST = "Baixo (<50%)"


def completeness_levels(silver: DataFrame, score: str = "_completude_score") -> DataFrame:
    steps = [(F.col(score) >= bound, label) for bound, label in COMPLETENESS_LEVELS]
    level = thresholds(F.lit(True), steps, COMPLETENESS_REST).alias("nivel_completude")
    counts = silver.groupBy(level).agg(rows().alias("casos"))
    return counts.withColumn(
        "percentual", rate(F.col("casos"), F.sum("casos").over(Window.partitionBy()))
    ).orderBy(F.desc("percentual"), "nivel_completude")


# Names of the day gaps.
GAP_EVENTS = [
    ("Sintoma → Notificação", "tempo_sintoma_notificacao"),
    ("Sintoma → Internação", "tempo_sintoma_internacao"),
    ("Duração da Internação", "tempo_internacao"),
]


def event_times(silver: DataFrame, events: Sequence[tuple[str, str]] = GAP_EVENTS) -> DataFrame:
    """Mean and median days of each gap, from one aggregate."""
    return measures_to_rows(
        silver,
        [
            ({"evento": name}, {"media_dias": mean(gap), "mediana_dias": F.round(median(gap), 1)})
            for name, gap in events
        ],
    )


def mortality_by_file_year(raw: DataFrame, year: str = "ANO_DADOS", outcome: str = "EVOLUCAO") -> DataFrame:
    """Mortality by source year through a pivot of the known outcome codes."""
    pivot = (
        raw.filter(F.col(outcome).isin(CURED, DIED))
        .groupBy(year)
        .pivot(outcome, [CURED, DIED])
        .count()
        .fillna(0)
        .withColumnsRenamed({CURED: "curas", DIED: "obitos"})
    )
    return pivot.withColumn("taxa_mortalidade", rate(F.col("obitos"), F.col("curas") + F.col("obitos")))


def code_distributions(
    df: DataFrame, specs: Sequence[tuple[str, Mapping[str, str], Column | None]]
) -> DataFrame:
    """Cases and share per labelled code of several variables, from one aggregate.

    A spec is (column, {code: label}, extra condition). Codes without a label are not counted;
    codes without cases give no row.
    """
    entries = []
    for name, labels, extra in specs:
        for code, label in labels.items():
            hit = F.col(name) == code
            known = F.col(name).isin(*labels)
            if extra is not None:
                hit, known = hit & extra, known & extra
            entries.append(
                (
                    {"variavel": name, "codigo": code, "label": label},
                    {"casos": F.count_if(hit), "percentual": rate(F.count_if(hit), F.count_if(known))},
                )
            )
    return measures_to_rows(df, entries).filter(F.col("casos") > 0)


def missing_fields(df: DataFrame, fields: Sequence[str] = MISSING_FIELDS) -> DataFrame:
    """NULL or empty per field with %, most missing first."""
    present = [f for f in fields if f in df.columns]
    entries = [
        (
            {"campo": f},
            {
                "missing_count": F.count_if(is_missing(f)),
                "missing_pct": pct(F.count_if(is_missing(f)), rows()),
            },
        )
        for f in present
    ]
    return measures_to_rows(df, entries).orderBy(F.desc("missing_pct"), "campo")


def ignored_codes(df: DataFrame, fields: Sequence[str] = IGNORED_CODE_FIELDS, code: str = IGNORED) -> DataFrame:
    """Share of the ignored code per field with its severity."""
    entries = [
        (
            {"field": f},
            {"code9_count": F.count_if(F.col(f) == code), "_total": rows()},
        )
        for f in fields
        if f in df.columns
    ]
    exact = F.col("code9_count") / F.col("_total") * 100
    return (
        measures_to_rows(df, entries)
        .withColumns(
            {
                "code9_pct": pct(F.col("code9_count"), F.col("_total")),
                "severity": F.when(exact > 20, "HIGH").when(exact > 10, "MEDIUM").otherwise("LOW"),
            }
        )
        .drop("_total")
        .orderBy(F.desc("code9_pct"), "field")
    )


def monthly_counts(typed: DataFrame, month: Column, date: str = "dt_sin_pri") -> DataFrame:
    return typed.filter(F.col(date).isNotNull()).groupBy(month.alias("ano_mes")).agg(rows().alias("casos"))


def monthly_statistics(counts: DataFrame, month: str = "ano_mes", value: str = "casos") -> DataFrame:
    """Mean, median, extreme months (the earliest on a tie) and growth of a monthly series."""
    previous = F.lag(value).over(Window.orderBy(month))
    change = F.try_divide((F.col(value) - previous) * F.lit(100.0), previous.cast("double"))
    return counts.withColumn("_growth", change).agg(
        F.round(F.avg(value), 2).alias("media_mensal"),
        F.median(value).alias("mediana_mensal"),
        F.min_by(month, F.struct(-F.col(value), F.col(month))).alias("mes_maximo"),
        F.max(value).alias("casos_maximo"),
        F.min_by(month, F.struct(value, month)).alias("mes_minimo"),
        F.min(value).alias("casos_minimo"),
        F.round(F.avg("_growth"), 2).alias("crescimento_medio"),
        F.round(F.max("_growth"), 2).alias("crescimento_maximo"),
        F.round(F.min("_growth"), 2).alias("crescimento_minimo"),
    )


def seasonality(df: DataFrame, week: str = "SEM_PRI", year: str = "ANO_DADOS", n: int = 5) -> DataFrame:
    """Mean cases per week number across years; the busiest weeks."""
    return (
        df.filter(F.col(week).isNotNull())
        .groupBy(week, year)
        .agg(rows().alias("_casos"))
        .groupBy(week)
        .agg(F.round(F.avg("_casos"), 2).alias("media_casos"))
        .orderBy(F.desc("media_casos"), week)
        .limit(n)
    )


def recent_days(typed: DataFrame, days: int = 90, anchor=None, date: str = "dt_sin_pri") -> DataFrame:
    """Daily statistics of the last days before the anchor; the earliest day wins a tie."""
    daily = typed.filter(since_days(date, days, anchor)).groupBy(date).agg(rows().alias("_casos"))
    return daily.agg(
        F.min(date).alias("inicio"),
        F.max(date).alias("fim"),
        F.sum("_casos").alias("total"),
        F.round(F.avg("_casos"), 1).alias("media_diaria"),
        F.max("_casos").alias("maximo_diario"),
        F.min_by(date, F.struct(-F.col("_casos"), F.col(date))).alias("dia_maximo"),
    )
