"""Gold tables: monthly, state, age by sex, series and national KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episurv.functions.codes import AGE_BANDS, SEX_LABELS, SEX_UNKNOWN
from episurv.functions.columns import ordinal, rate, recode
from episurv.operators.rates import (
    cures,
    deaths,
    growth,
    icu_rate,
    mean,
    mortality,
    rows,
    true_count,
    vaccination,
    with_outcome,
    with_vaccine_answer,
)
from episurv.operators.typing import pad_to_schema


def _with_distinct_ids(measures: DataFrame, silver: DataFrame, keys: list[str], key: str, key_is_unique: bool) -> DataFrame:
    """Distinct case ids per group beside its measures.

    A distinct count moves every id. Inside the measures it would move all counters with each id,
    so it is an aggregate of its own that reads the ids only, joined on the few groups. Where the
    key is known to be unique, as after de-duplication, it is the plain count the measures hold.
    """
    if key_is_unique:
        return measures.withColumnRenamed("_ids", "casos_unicos")
    ids = silver.groupBy(*keys).agg(F.count_distinct(key).alias("casos_unicos"))
    same = [measures[k].eqNullSafe(ids[k]) for k in keys]
    return measures.join(ids, same).select(
        *[ids["casos_unicos"] if c == "_ids" else measures[c] for c in measures.columns]
    )


MONTH = ("ano", "mes", "ano_mes")
MONTH_FLAGS = {
    "total_internados": "is_internado", "total_uti": "is_uti", "total_vacinados": "is_vacinado",
    "casos_com_febre": "has_febre", "casos_com_tosse": "has_tosse", "casos_com_dispneia": "has_dispneia",
}
GAPS = {
    "tempo_medio_notificacao": "tempo_sintoma_notificacao",
    "tempo_medio_internacao": "tempo_sintoma_internacao",
    "duracao_media_internacao": "tempo_internacao",
}


def age_partials(silver: DataFrame, key: str = "nu_notific", elderly: Column | None = None) -> DataFrame:
    """Counts and sums per month and year of age. They add up over any rows, so months can be replaced or merged."""
    return silver.groupBy(*MONTH, "nu_idade_n").agg(
        rows().alias("total_casos"),
        F.count(key).alias("_ids"),
        deaths().alias("total_obitos"),
        cures().alias("total_curas"),
        with_outcome().alias("casos_com_desfecho"),
        with_vaccine_answer().alias("casos_com_info_vacina"),
        *[true_count(c).alias(name) for name, c in MONTH_FLAGS.items()],
        *[F.sum(c).alias(f"_sum_{name}") for name, c in GAPS.items()],
        *[F.count(c).alias(f"_n_{name}") for name, c in GAPS.items()],
        *([] if elderly is None else [elderly]),
    )


def monthly_of_partials(by_age: DataFrame) -> DataFrame:
    """One row per month from `age_partials`, without distinct ids and growth."""
    age, n = F.col("nu_idade_n"), F.col("total_casos")
    counts = ["_ids", "total_obitos", "total_curas", "casos_com_desfecho", "casos_com_info_vacina", *MONTH_FLAGS]
    added = by_age.groupBy(*MONTH).agg(
        F.sum("total_casos").alias("total_casos"),
        F.round(F.try_divide(F.sum(age * n).cast("double"), F.sum(F.when(age.isNotNull(), n)).cast("double")), 1).alias("idade_media"),
        F.percentile(age, 0.5, n).alias("idade_mediana"),
        *[F.sum(c).alias(c) for c in counts],
        *[
            F.round(F.try_divide(F.sum(f"_sum_{g}").cast("double"), F.sum(f"_n_{g}").cast("double")), 1).alias(g)
            for g in GAPS
        ],
    )
    return added.withColumns(
        {
            "taxa_mortalidade": rate(F.col("total_obitos"), F.col("casos_com_desfecho")),
            "taxa_uti": rate(F.col("total_uti"), F.col("total_internados")),
            "taxa_vacinacao": rate(F.col("total_vacinados"), F.col("casos_com_info_vacina")),
        }
    )


def monthly_metrics(silver: DataFrame, key: str = "nu_notific", key_is_unique: bool = False) -> DataFrame:
    """One row per month.

    Cases are first added up per month and year of age. Those sums combine in the map tasks, and
    the exact median then weighs at most one row per age instead of buffering the cases.
    """
    monthly = monthly_of_partials(age_partials(silver, key))
    return growth(_with_distinct_ids(monthly, silver, list(MONTH), key, key_is_unique), "total_casos", "ano_mes")


def state_profile(silver: DataFrame, key: str = "nu_notific", key_is_unique: bool = False) -> DataFrame:
    """One row per state. The national share counts rows without a state in its denominator.

    The NULL state is one more group of the same aggregate, so the national total is a window sum
    over the grouped rows and needs no second scan. Municipalities combine in the map tasks: there
    are few per state.
    """
    by_state = silver.groupBy("sg_uf").agg(
        rows().alias("total_casos"),
        F.count(key).alias("_ids"),
        F.count_distinct("co_mun_res").alias("municipios_afetados"),
        mean("nu_idade_n").alias("idade_media"),
        true_count("is_idoso").alias("casos_idosos"),
        rate(true_count("is_idoso"), rows()).alias("percentual_idosos"),
        F.count_if(F.col("cs_sexo_clean") == "1").alias("casos_masculino"),
        F.count_if(F.col("cs_sexo_clean") == "2").alias("casos_feminino"),
        deaths().alias("total_obitos"),
        with_outcome().alias("casos_com_desfecho"),
        mortality().alias("taxa_mortalidade"),
        true_count("is_internado").alias("total_internados"),
        true_count("is_uti").alias("total_uti"),
        icu_rate().alias("taxa_uti"),
        true_count("is_vacinado").alias("total_vacinados"),
        with_vaccine_answer().alias("casos_com_info_vacina"),
        vaccination().alias("taxa_vacinacao"),
        F.min("dt_sin_pri").alias("data_primeiro_caso"),
        F.max("dt_sin_pri").alias("data_ultimo_caso"),
        mean("tempo_sintoma_notificacao").alias("tempo_medio_notificacao"),
        mean("tempo_internacao").alias("duracao_media_internacao"),
    )
    return (
        _with_distinct_ids(by_state, silver, ["sg_uf"], key, key_is_unique)
        .withColumn("_nacional", F.sum("total_casos").over(Window.partitionBy()))
        .filter(F.col("sg_uf").isNotNull())
        .withColumn("ranking_casos", F.row_number().over(Window.orderBy(F.desc("total_casos"), "sg_uf")))
        .withColumn("percentual_nacional", rate(F.col("total_casos"), F.col("_nacional")))
        .drop("_nacional")
    )


def age_sex_profile(silver: DataFrame) -> DataFrame:
    """One row per age band and sex; unknown sex is a group of its own."""
    groups = silver.filter(F.col("faixa_etaria").isNotNull()).groupBy("faixa_etaria", "cs_sexo_clean")
    profile = groups.agg(
        rows().alias("total_casos"),
        deaths().alias("total_obitos"),
        with_outcome().alias("casos_com_desfecho"),
        mortality().alias("taxa_mortalidade"),
        true_count("is_internado").alias("total_internados"),
        rate(true_count("is_internado"), rows()).alias("taxa_internacao"),
        true_count("is_uti").alias("total_uti"),
        icu_rate().alias("taxa_uti"),
        true_count("is_vacinado").alias("total_vacinados"),
        with_vaccine_answer().alias("casos_com_info_vacina"),
        vaccination().alias("taxa_vacinacao"),
        mean("tempo_internacao").alias("duracao_media_internacao"),
    )
    total = F.sum("total_casos").over(Window.partitionBy())
    return profile.withColumns(
        {
            "sexo_label": recode("cs_sexo_clean", SEX_LABELS, SEX_UNKNOWN),
            "percentual_total": rate(F.col("total_casos"), total),
            "ordem_faixa": ordinal("faixa_etaria", [label for _, label in AGE_BANDS]),
        }
    )


# --- series ---------------------------------------------------------------------------------

SERIES_SCHEMA = {
    "data_referencia": "date",
    "ano": "int",
    "sem_pri": "int",
    "casos_dia": "bigint",
    "obitos_dia": "bigint",
    "internacoes_dia": "bigint",
    "uti_dia": "bigint",
    "casos_semana": "bigint",
    "obitos_semana": "bigint",
    "internacoes_semana": "bigint",
    "uti_semana": "bigint",
    "casos_ma7": "double",
    "obitos_ma7": "double",
    "data_inicio_semana": "date",
    "data_fim_semana": "date",
    "tipo_agregacao": "string",
}


def _volume(suffix: str):
    return [
        rows().alias(f"casos_{suffix}"),
        deaths().alias(f"obitos_{suffix}"),
        true_count("is_internado").alias(f"internacoes_{suffix}"),
        true_count("is_uti").alias(f"uti_{suffix}"),
    ]


def daily_series(silver: DataFrame, date: str = "dt_sin_pri", calendar: bool = False) -> DataFrame:
    """Cases per symptom day with trailing 7-row means.

    The frame counts rows: a day without cases is no row. With `calendar` every day between the
    first and the last becomes a row, so the frame spans 7 days.
    """
    daily = silver.groupBy(date).agg(*_volume("dia"))
    if calendar:
        days = daily.agg(F.explode(F.sequence(F.min(date), F.max(date))).alias(date))
        daily = days.join(daily, date, "left").fillna(
            0, ["casos_dia", "obitos_dia", "internacoes_dia", "uti_dia"]
        )
    week = Window.orderBy(date).rowsBetween(-6, 0)
    return daily.withColumns(
        {
            "casos_ma7": F.round(F.avg("casos_dia").over(week), 1),
            "obitos_ma7": F.round(F.avg("obitos_dia").over(week), 1),
        }
    )


def weekly_series(silver: DataFrame, date: str = "dt_sin_pri") -> DataFrame:
    """Cases per calendar year and epidemiological week."""
    return (
        silver.filter(F.col("sem_pri").isNotNull())
        .groupBy("ano", "sem_pri")
        .agg(*_volume("semana"), F.min(date).alias("data_inicio_semana"), F.max(date).alias("data_fim_semana"))
    )


def series_table(silver: DataFrame, date: str = "dt_sin_pri") -> DataFrame:
    """Both grains in one wide schema, told apart by `tipo_agregacao`.

    The cases are read once: they are added up per day and week number, and both grains are
    grouping sets over those few rows.
    """
    volumes = ["casos", "obitos", "internacoes", "uti"]
    per_day = silver.groupBy(date, "ano", "sem_pri").agg(
        rows().alias("casos"), deaths().alias("obitos"),
        true_count("is_internado").alias("internacoes"), true_count("is_uti").alias("uti"),
    )
    grains = per_day.withColumn("_day", F.col(date)).groupingSets([[date], ["ano", "sem_pri"]], date, "ano", "sem_pri").agg(
        *[F.sum(c).alias(c) for c in volumes],
        (F.grouping(date) == 0).alias("_daily"),
        F.min("_day").alias("_first"),
        F.max("_day").alias("_last"),
    )
    daily, known = F.col("_daily"), F.col("_daily") | F.col("sem_pri").isNotNull()
    week = Window.partitionBy("_daily").orderBy("_first", "sem_pri").rowsBetween(-6, 0)
    columns = {
        "data_referencia": F.col("_first"),
        "ano": F.when(daily, F.year("_first")).otherwise(F.col("ano")),
        **{f"{c}_dia": F.when(daily, F.col(c)) for c in volumes},
        **{f"{c}_semana": F.when(~daily, F.col(c)) for c in volumes},
        "casos_ma7": F.when(daily, F.round(F.avg("casos").over(week), 1)),
        "obitos_ma7": F.when(daily, F.round(F.avg("obitos").over(week), 1)),
        "data_inicio_semana": F.when(~daily, F.col("_first")),
        "data_fim_semana": F.when(~daily, F.col("_last")),
        "tipo_agregacao": F.when(daily, "diaria").otherwise("semanal"),
    }
    return pad_to_schema(grains.filter(known).withColumns(columns), SERIES_SCHEMA)


# --- national KPIs --------------------------------------------------------------------------


def national_kpis(silver: DataFrame) -> DataFrame:
    """16 national measures in one row.

    The distinct count runs over the few states, so it rides on the same single pass.
    """
    return silver.agg(
        rows().alias("total_casos"),
        F.count_distinct("sg_uf").alias("ufs_afetadas"),
        deaths().alias("total_obitos"),
        with_outcome().alias("casos_com_desfecho"),
        true_count("is_internado").alias("total_internacoes"),
        true_count("is_uti").alias("total_uti"),
        true_count("is_vacinado").alias("total_vacinados"),
        with_vaccine_answer().alias("casos_com_info_vacina"),
        true_count("is_idoso").alias("total_idosos"),
        F.avg("nu_idade_n").alias("idade_media"),
        F.avg("tempo_sintoma_notificacao").alias("tempo_notif"),
        F.avg("tempo_internacao").alias("duracao_int"),
        mortality().alias("taxa_mortalidade"),
        icu_rate().alias("taxa_uti"),
        vaccination().alias("taxa_vacinacao"),
        rate(true_count("is_idoso"), rows()).alias("pct_idosos"),
    )


# The 12 published KPIs as (category, metric, source measure, digits, unit, description).
KPI_ROWS = [
    ("Casos", "Total de Casos", "total_casos", None, "casos", "Número total de notificações SRAG"),
    ("Mortalidade", "Taxa de Mortalidade (%)", "taxa_mortalidade", None, "%", "Percentual de óbitos entre casos com desfecho"),
    ("Mortalidade", "Total de Óbitos", "total_obitos", None, "casos", "Óbitos confirmados"),
    ("UTI", "Taxa de Ocupação UTI (%)", "taxa_uti", None, "%", "Percentual de internados em UTI"),
    ("UTI", "Total em UTI", "total_uti", None, "casos", "Casos em UTI"),
    ("Vacinacao", "Taxa de Vacinação (%)", "taxa_vacinacao", None, "%", "Percentual de vacinados"),
    ("Internacao", "Total de Internações", "total_internacoes", None, "casos", "Casos hospitalizados"),
    ("Demografia", "Idade Média (anos)", "idade_media", 1, "anos", "Idade média dos casos"),
    ("Demografia", "Percentual de Idosos (%)", "pct_idosos", None, "%", "Casos com 60+ anos"),
    ("Geografia", "UFs Afetadas", "ufs_afetadas", None, "UFs", "Estados com casos"),
    ("Tempo", "Tempo Médio Notificação (dias)", "tempo_notif", 1, "dias", "Sintomas até notificação"),
    ("Tempo", "Duração Média Internação (dias)", "duracao_int", 1, "dias", "Dias de internação"),
]
KPI_SCOPE = "Nacional"


def kpi_rows(kpis: DataFrame, scope: str = KPI_SCOPE) -> DataFrame:
    """One row per KPI from the one row of measures; a missing value is published as 0."""

    def entry(category, metric, measure, digits, unit, text):
        value = F.coalesce(F.col(measure).cast("double"), F.lit(0.0))
        return F.struct(
            F.lit(category).alias("categoria"),
            F.lit(metric).alias("metrica"),
            (value if digits is None else F.round(value, digits)).alias("valor"),
            F.lit(unit).alias("unidade"),
            F.lit(text).alias("descricao"),
            F.lit(scope).alias("escopo"),
        )

    return kpis.select(F.inline(F.array(*[entry(*row) for row in KPI_ROWS])))
