"""Rates and gold tables over the case table."""

from __future__ import annotations

from pyspark.sql import functions as F

from episurv.functions.columns import rate
from episurv.operators import explore, series
from episurv.operators import rates as r
from episurv.plans import gold, views
from episurv.plans.cases import raw_cases
from episurv.plans.silver import silver_of, written_silver
from episurv.registry import query
from episurv.registry.sql import (
    ADMITTED, DEATHS, ICU, ICU_RATE, MORTALITY, OUTCOMES, RAW, SILVER, VACCINATED, VACCINATION, VACCINE_KNOWN, n_if,
)
from episurv.registry.sql import rate as sql_rate

MONTHLY = f"""monthly AS (
  SELECT ano, mes, ano_mes, count(*) AS total_casos, count(DISTINCT nu_notific) AS casos_unicos,
    round(avg(nu_idade_n), 1) AS idade_media, quantile_cont(nu_idade_n, 0.5) AS idade_mediana,
    {DEATHS} AS total_obitos, {n_if("evolucao_clean = '1'")} AS total_curas, {OUTCOMES} AS casos_com_desfecho,
    {MORTALITY} AS taxa_mortalidade, {ADMITTED} AS total_internados, {ICU} AS total_uti, {ICU_RATE} AS taxa_uti,
    {VACCINATED} AS total_vacinados, {VACCINE_KNOWN} AS casos_com_info_vacina, {VACCINATION} AS taxa_vacinacao,
    {n_if('has_febre')} AS casos_com_febre, {n_if('has_tosse')} AS casos_com_tosse,
    {n_if('has_dispneia')} AS casos_com_dispneia,
    round(avg(tempo_sintoma_notificacao), 1) AS tempo_medio_notificacao,
    round(avg(tempo_sintoma_internacao), 1) AS tempo_medio_internacao,
    round(avg(tempo_internacao), 1) AS duracao_media_internacao
  FROM silver GROUP BY ano, mes, ano_mes
),
monthly_metrics AS (
  SELECT *, round((total_casos - lag(total_casos) OVER (ORDER BY ano_mes)) * 100.0::DOUBLE
    / nullif(lag(total_casos) OVER (ORDER BY ano_mes), 0), 2) AS taxa_crescimento FROM monthly
)"""


@query("a12_monthly_metrics", f"{SILVER}, {MONTHLY} SELECT * FROM monthly_metrics")
def a12(spark, d):
    """The key is unique here: the case table keeps one row per key."""
    return gold.monthly_metrics(silver_of(spark, d), key_is_unique=True)


@query("a12_monthly_metrics_any_key", f"{SILVER}, {MONTHLY} SELECT * FROM monthly_metrics")
def a12_any_key(spark, d):
    return gold.monthly_metrics(silver_of(spark, d))


# --- kernel -----------------------------------------------------------------------------------


@query("a1_count_by", f"{RAW} SELECT ANO_DADOS, count(*) AS registros FROM raw GROUP BY ANO_DADOS")
def a1(spark, d):
    return raw_cases(spark, d).groupBy("ANO_DADOS").agg(r.rows().alias("registros")).orderBy("ANO_DADOS")


@query(
    "a2_count_if",
    f"""{SILVER} SELECT ano, {DEATHS} AS obitos, {n_if("evolucao_clean = '1'")} AS curas, {OUTCOMES} AS casos_com_desfecho
    FROM silver GROUP BY ano""",
)
def a2(spark, d):
    return silver_of(spark, d).groupBy("ano").agg(
        r.deaths().alias("obitos"), r.cures().alias("curas"), r.with_outcome().alias("casos_com_desfecho")
    )


@query(
    "a3_rate_kernel",
    f"""{SILVER} SELECT dia_semana, {sql_rate(n_if("faixa_etaria = 'Desconhecido'"), 'count(*)')} AS pct_sem_idade,
    {sql_rate(DEATHS, n_if("evolucao_clean = 'x'"))} AS taxa_base_zero FROM silver GROUP BY dia_semana""",
)
def a3(spark, d):
    return silver_of(spark, d).groupBy("dia_semana").agg(
        rate(F.count_if(F.col("faixa_etaria") == "Desconhecido"), r.rows()).alias("pct_sem_idade"),
        rate(r.deaths(), F.count_if(F.col("evolucao_clean") == "x")).alias("taxa_base_zero"),
    )


@query(
    "a4_mortality_by_year",
    f"""{SILVER} SELECT ano, count(*) AS total_casos, {DEATHS} AS obitos, {n_if("evolucao_clean = '1'")} AS curas,
    {OUTCOMES} AS casos_com_desfecho, {MORTALITY} AS taxa_mortalidade FROM silver GROUP BY ano""",
)
def a4(spark, d):
    return silver_of(spark, d).groupBy("ano").agg(
        r.rows().alias("total_casos"), r.deaths().alias("obitos"), r.cures().alias("curas"),
        r.with_outcome().alias("casos_com_desfecho"), r.mortality().alias("taxa_mortalidade"),
    )


@query("a5_icu_rate_by_year", f"{SILVER} SELECT ano, {ADMITTED} AS total_internados, {ICU} AS casos_uti, {ICU_RATE} AS taxa_uti FROM silver GROUP BY ano")
def a5(spark, d):
    return silver_of(spark, d).groupBy("ano").agg(
        r.true_count("is_internado").alias("total_internados"), r.true_count("is_uti").alias("casos_uti"),
        r.icu_rate().alias("taxa_uti"),
    )


@query(
    "a6_icu_rate_strict",
    f"""{RAW} SELECT count(*) AS total_hospitalizados, {n_if("UTI = '1'")} AS casos_uti,
    {sql_rate(n_if("UTI = '1'"), 'count(*)')} AS taxa_uti FROM raw WHERE HOSPITAL = '1' AND UTI IN ('1', '2')""",
)
def a6(spark, d):
    return r.strict_icu_rate(raw_cases(spark, d))


@query(
    "a7_vaccination_by_year",
    f"{SILVER} SELECT ano, count(*) AS total_casos, {VACCINATED} AS vacinados, {VACCINE_KNOWN} AS casos_com_info, {VACCINATION} AS taxa_vacinacao FROM silver GROUP BY ano",
)
def a7(spark, d):
    return silver_of(spark, d).groupBy("ano").agg(
        r.rows().alias("total_casos"), r.true_count("is_vacinado").alias("vacinados"),
        r.with_vaccine_answer().alias("casos_com_info"), r.vaccination().alias("taxa_vacinacao"),
    )


@query(
    "a8_mortality_over_all_rows",
    f"""{SILVER} SELECT faixa_etaria, count(*) AS casos, round(avg(CASE WHEN is_obito THEN 100.0::DOUBLE ELSE 0 END), 2) AS taxa_mortalidade
    FROM silver WHERE faixa_etaria <> 'Desconhecido' GROUP BY faixa_etaria""",
)
def a8(spark, d):
    return explore.band_mortality(silver_of(spark, d))


@query(
    "a9_count_distinct",
    f"""{SILVER} SELECT ano, count(DISTINCT nu_notific) AS ids, count(DISTINCT co_mun_res) AS municipios,
    count(DISTINCT sg_uf) AS ufs FROM silver GROUP BY ano""",
)
def a9(spark, d):
    silver = written_silver(spark, d)
    ids = silver.groupBy("ano").agg(F.count_distinct("nu_notific").alias("ids"))
    places = silver.groupBy("ano").agg(F.count_distinct("co_mun_res").alias("municipios"), F.count_distinct("sg_uf").alias("ufs"))
    return ids.join(places, ids["ano"].eqNullSafe(places["ano"])).select(ids["ano"], "ids", "municipios", "ufs")


@query(
    "a10_mean_and_median",
    f"{SILVER} SELECT ano, sg_uf, round(avg(nu_idade_n), 1) AS idade_media, quantile_cont(nu_idade_n, 0.5) AS idade_mediana FROM silver GROUP BY ano, sg_uf",
)
def a10(spark, d):
    found = r.mean_and_median(silver_of(spark, d), ["ano", "sg_uf"], "nu_idade_n")
    return found.withColumnsRenamed({"media": "idade_media", "mediana": "idade_mediana"})


@query("a11_period", f"{SILVER} SELECT count(*) AS registros, CAST(min(dt_sin_pri) AS VARCHAR) AS min_data, CAST(max(dt_sin_pri) AS VARCHAR) AS max_data FROM silver")
def a11(spark, d):
    return silver_of(spark, d).agg(
        r.rows().alias("registros"), F.min("dt_sin_pri").alias("min_data"), F.max("dt_sin_pri").alias("max_data")
    )


# --- tables -----------------------------------------------------------------------------------

STATES = f"""state_profile AS (
  SELECT sg_uf, count(*) AS total_casos, count(DISTINCT nu_notific) AS casos_unicos,
    count(DISTINCT co_mun_res) AS municipios_afetados, round(avg(nu_idade_n), 1) AS idade_media,
    {n_if('is_idoso')} AS casos_idosos, {sql_rate(n_if('is_idoso'), 'count(*)')} AS percentual_idosos,
    {n_if("cs_sexo_clean = '1'")} AS casos_masculino, {n_if("cs_sexo_clean = '2'")} AS casos_feminino,
    {DEATHS} AS total_obitos, {OUTCOMES} AS casos_com_desfecho, {MORTALITY} AS taxa_mortalidade,
    {ADMITTED} AS total_internados, {ICU} AS total_uti, {ICU_RATE} AS taxa_uti,
    {VACCINATED} AS total_vacinados, {VACCINE_KNOWN} AS casos_com_info_vacina, {VACCINATION} AS taxa_vacinacao,
    CAST(min(dt_sin_pri) AS VARCHAR) AS data_primeiro_caso, CAST(max(dt_sin_pri) AS VARCHAR) AS data_ultimo_caso,
    round(avg(tempo_sintoma_notificacao), 1) AS tempo_medio_notificacao,
    round(avg(tempo_internacao), 1) AS duracao_media_internacao,
    CAST(row_number() OVER (ORDER BY count(*) DESC, sg_uf) AS INTEGER) AS ranking_casos,
    {sql_rate('count(*)', '(SELECT count(*) FROM silver)')} AS percentual_nacional
  FROM silver WHERE sg_uf IS NOT NULL GROUP BY sg_uf
)"""


@query("a13_state_profile", f"{SILVER}, {STATES} SELECT * FROM state_profile")
def a13(spark, d):
    return gold.state_profile(silver_of(spark, d), key_is_unique=True)


BAND_ORDER = "['0-1 ano','1-4 anos','5-9 anos','10-17 anos','18-29 anos','30-39 anos','40-49 anos','50-59 anos','60-69 anos','70+ anos']"
AGE_SEX = f"""age_sex AS (
  SELECT faixa_etaria, cs_sexo_clean, count(*) AS total_casos, {DEATHS} AS total_obitos,
    {OUTCOMES} AS casos_com_desfecho, {MORTALITY} AS taxa_mortalidade, {ADMITTED} AS total_internados,
    {sql_rate(ADMITTED, 'count(*)')} AS taxa_internacao, {ICU} AS total_uti, {ICU_RATE} AS taxa_uti,
    {VACCINATED} AS total_vacinados, {VACCINE_KNOWN} AS casos_com_info_vacina, {VACCINATION} AS taxa_vacinacao,
    round(avg(tempo_internacao), 1) AS duracao_media_internacao,
    CASE cs_sexo_clean WHEN '1' THEN 'Masculino' WHEN '2' THEN 'Feminino' ELSE 'Não informado' END AS sexo_label,
    {sql_rate('count(*)', 'sum(count(*)) OVER ()')} AS percentual_total,
    coalesce(CAST(list_position({BAND_ORDER}, faixa_etaria) AS INTEGER), 99) AS ordem_faixa
  FROM silver GROUP BY faixa_etaria, cs_sexo_clean
)"""


@query("a14_age_sex_profile", f"{SILVER}, {AGE_SEX} SELECT * FROM age_sex")
def a14(spark, d):
    return gold.age_sex_profile(silver_of(spark, d))


DAILY = f"""daily AS (
  SELECT *, round(avg(casos_dia) OVER w, 1) AS casos_ma7, round(avg(obitos_dia) OVER w, 1) AS obitos_ma7
  FROM (SELECT dt_sin_pri, count(*) AS casos_dia, {DEATHS} AS obitos_dia, {ADMITTED} AS internacoes_dia,
    {ICU} AS uti_dia FROM silver GROUP BY dt_sin_pri)
  WINDOW w AS (ORDER BY dt_sin_pri ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
)"""
WEEKLY = f"""weekly AS (
  SELECT ano, sem_pri, count(*) AS casos_semana, {DEATHS} AS obitos_semana, {ADMITTED} AS internacoes_semana,
    {ICU} AS uti_semana, min(dt_sin_pri) AS data_inicio_semana, max(dt_sin_pri) AS data_fim_semana
  FROM silver WHERE sem_pri IS NOT NULL GROUP BY ano, sem_pri
)"""


@query("a15_daily_series", f"{SILVER}, {DAILY} SELECT * REPLACE (CAST(dt_sin_pri AS VARCHAR) AS dt_sin_pri) FROM daily")
def a15(spark, d):
    return gold.daily_series(silver_of(spark, d))


@query(
    "a16_weekly_series",
    f"""{SILVER}, {WEEKLY} SELECT * REPLACE (CAST(data_inicio_semana AS VARCHAR) AS data_inicio_semana,
    CAST(data_fim_semana AS VARCHAR) AS data_fim_semana) FROM weekly""",
)
def a16(spark, d):
    return gold.weekly_series(silver_of(spark, d))


SERIES = """series AS (
  SELECT CAST(dt_sin_pri AS VARCHAR) AS data_referencia, CAST(year(dt_sin_pri) AS INTEGER) AS ano,
    CAST(NULL AS INTEGER) AS sem_pri, casos_dia, obitos_dia, internacoes_dia, uti_dia,
    CAST(NULL AS BIGINT) AS casos_semana, CAST(NULL AS BIGINT) AS obitos_semana,
    CAST(NULL AS BIGINT) AS internacoes_semana, CAST(NULL AS BIGINT) AS uti_semana, casos_ma7, obitos_ma7,
    CAST(NULL AS VARCHAR) AS data_inicio_semana, CAST(NULL AS VARCHAR) AS data_fim_semana, 'diaria' AS tipo_agregacao
  FROM daily
  UNION ALL
  SELECT CAST(data_inicio_semana AS VARCHAR), ano, sem_pri, NULL, NULL, NULL, NULL, casos_semana, obitos_semana,
    internacoes_semana, uti_semana, NULL, NULL, CAST(data_inicio_semana AS VARCHAR), CAST(data_fim_semana AS VARCHAR),
    'semanal'
  FROM weekly
)"""


@query("a17_series_table", f"{SILVER}, {DAILY}, {WEEKLY}, {SERIES} SELECT * FROM series")
def a17(spark, d):
    return gold.series_table(silver_of(spark, d))


KPIS = f"""kpis AS (
  SELECT count(*) AS total_casos, count(DISTINCT sg_uf) AS ufs_afetadas, {DEATHS} AS total_obitos,
    {OUTCOMES} AS casos_com_desfecho, {ADMITTED} AS total_internacoes, {ICU} AS total_uti,
    {VACCINATED} AS total_vacinados, {VACCINE_KNOWN} AS casos_com_info_vacina, {n_if('is_idoso')} AS total_idosos,
    avg(nu_idade_n) AS idade_media, avg(tempo_sintoma_notificacao) AS tempo_notif, avg(tempo_internacao) AS duracao_int,
    {MORTALITY} AS taxa_mortalidade, {ICU_RATE} AS taxa_uti, {VACCINATION} AS taxa_vacinacao,
    {sql_rate(n_if('is_idoso'), 'count(*)')} AS pct_idosos
  FROM silver
)"""


@query("a18_national_kpis", f"{SILVER}, {KPIS} SELECT * FROM kpis")
def a18(spark, d):
    return gold.national_kpis(silver_of(spark, d))


def _kpi_long_sql() -> str:
    parts = []
    for category, metric, measure, digits, unit, text in gold.KPI_ROWS:
        value = f"coalesce(CAST({measure} AS DOUBLE), 0)"
        value = value if digits is None else f"round({value}, {digits})"
        parts.append(
            f"SELECT '{category}' AS categoria, '{metric}' AS metrica, {value} AS valor, '{unit}' AS unidade, "
            f"'{text}' AS descricao, 'Nacional' AS escopo FROM kpis"
        )
    return "kpi_long AS (" + " UNION ALL ".join(parts) + ")"


KPI_LONG = _kpi_long_sql()


@query("a19_kpi_rows", f"{SILVER}, {KPIS}, {KPI_LONG} SELECT * FROM kpi_long")
def a19(spark, d):
    return gold.kpi_rows(gold.national_kpis(silver_of(spark, d)))


# --- windows over the aggregates --------------------------------------------------------------


@query("w1_growth", f"""{SILVER} SELECT ano, casos, round((casos - lag(casos) OVER (ORDER BY ano)) * 100.0::DOUBLE
    / nullif(lag(casos) OVER (ORDER BY ano), 0), 2) AS variacao_pct FROM (SELECT ano, count(*) AS casos FROM silver GROUP BY ano)""")
def w1(spark, d):
    yearly = silver_of(spark, d).groupBy("ano").agg(r.rows().alias("casos"))
    return r.growth(yearly, "casos", "ano", "variacao_pct")


@query("w2_rank", f"{SILVER}, {STATES} SELECT sg_uf, total_casos, ranking_casos FROM state_profile")
def w2(spark, d):
    by_state = silver_of(spark, d).filter(F.col("sg_uf").isNotNull()).groupBy("sg_uf").agg(r.rows().alias("total_casos"))
    return series.ranked(by_state, "total_casos", "sg_uf", "ranking_casos")


@query("w3_share_of_total", f"{SILVER} SELECT faixa_etaria, count(*) AS casos, {sql_rate('count(*)', 'sum(count(*)) OVER ()')} AS percentual FROM silver GROUP BY faixa_etaria")
def w3(spark, d):
    return series.with_share(silver_of(spark, d).groupBy("faixa_etaria").agg(r.rows().alias("casos")), "casos")


@query(
    "w4_calendar_moving_mean",
    f"""{SILVER}, days AS (SELECT CAST(unnest(generate_series(min(dt_sin_pri), max(dt_sin_pri), INTERVAL 1 DAY)) AS DATE) AS dia FROM silver),
    per_day AS (SELECT dia, count(nu_notific) AS casos_dia, {DEATHS} AS obitos_dia,
      {n_if('coalesce(is_internado, false)')} AS internacoes_dia, {n_if('coalesce(is_uti, false)')} AS uti_dia
      FROM days LEFT JOIN silver ON dia = dt_sin_pri GROUP BY dia)
    SELECT CAST(dia AS VARCHAR) AS dt_sin_pri, casos_dia, obitos_dia, internacoes_dia, uti_dia,
      round(avg(casos_dia) OVER w, 1) AS casos_ma7, round(avg(obitos_dia) OVER w, 1) AS obitos_ma7
    FROM per_day WINDOW w AS (ORDER BY dia ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def w4(spark, d):
    return gold.daily_series(silver_of(spark, d), calendar=True)


_BANDING = """CASE WHEN taxa_crescimento IS NULL THEN 'dados_insuficientes' WHEN taxa_crescimento > 10 THEN 'crescimento_significativo'
  WHEN taxa_crescimento > 0 THEN 'crescimento_moderado' ELSE 'estabilizacao_ou_reducao' END AS faixa_crescimento,
  CASE WHEN taxa_mortalidade IS NULL THEN 'dados_insuficientes' WHEN taxa_mortalidade > 10 THEN 'alta' WHEN taxa_mortalidade > 5 THEN 'moderada' ELSE 'controlada' END AS faixa_mortalidade,
  CASE WHEN taxa_uti IS NULL THEN 'dados_insuficientes' WHEN taxa_uti > 70 THEN 'critica' WHEN taxa_uti > 50 THEN 'monitoramento' ELSE 'controlavel' END AS faixa_uti,
  CASE WHEN taxa_vacinacao IS NULL THEN 'dados_insuficientes' WHEN taxa_vacinacao > 70 THEN 'satisfatoria' WHEN taxa_vacinacao > 50 THEN 'em_expansao' ELSE 'abaixo_do_ideal' END AS faixa_vacinacao"""


@query(
    "w9_latest_vs_previous",
    f"""{SILVER}, {MONTHLY} SELECT ano_mes, taxa_crescimento, crescimento_anterior, total_casos, taxa_mortalidade,
    taxa_uti, taxa_vacinacao, {_BANDING} FROM (SELECT *, lag(taxa_crescimento) OVER (ORDER BY ano_mes) AS crescimento_anterior
    FROM monthly_metrics) ORDER BY ano_mes DESC LIMIT 1""",
)
def w9(spark, d):
    return series.latest_with_bands(gold.monthly_metrics(silver_of(spark, d), key_is_unique=True))


# --- views ------------------------------------------------------------------------------------


@query(
    "v1_dashboard",
    f"""{SILVER}, {KPIS}, {KPI_LONG}, {MONTHLY} SELECT l.*, m.ano_mes AS ultimo_mes, m.total_casos AS casos_ultimo_mes,
    m.taxa_crescimento AS crescimento_ultimo_mes FROM kpi_long l CROSS JOIN
    (SELECT * FROM monthly_metrics ORDER BY ano_mes DESC LIMIT 1) m""",
)
def v1(spark, d):
    silver = written_silver(spark, d)
    return views.dashboard(gold.kpi_rows(gold.national_kpis(silver)), gold.monthly_metrics(silver, key_is_unique=True))


@query("v2_last_six_months", f"{SILVER}, {MONTHLY} SELECT * FROM monthly_metrics ORDER BY ano_mes DESC LIMIT 6")
def v2(spark, d):
    return views.last_months(gold.monthly_metrics(silver_of(spark, d), key_is_unique=True), 6)


@query("v3_top_states", f"{SILVER}, {STATES} SELECT * FROM state_profile WHERE ranking_casos <= 10")
def v3(spark, d):
    return views.top_states(gold.state_profile(silver_of(spark, d), key_is_unique=True), 10)


@query("v4_mortality_alerts", f"{SILVER}, {STATES} SELECT * FROM state_profile WHERE taxa_mortalidade > 10")
def v4(spark, d):
    return views.mortality_alerts(gold.state_profile(silver_of(spark, d), key_is_unique=True))


@query("v5_current_summary", f"{SILVER}, {KPIS}, {KPI_LONG} SELECT *, '2024-02-01' AS data_snapshot FROM kpi_long")
def v5(spark, d):
    kpis = gold.kpi_rows(gold.national_kpis(silver_of(spark, d)))
    history = kpis.select("*", F.explode(F.array(F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-02-01")))).alias("data_snapshot"))
    return views.current_summary(history)
