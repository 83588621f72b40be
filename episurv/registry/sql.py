"""Common table expressions of the SQL twins: raw notifications, typed cases, silver."""

from __future__ import annotations


def _mixed(d: str, j: str) -> str:
    return (
        f"CASE WHEN ({j}) % 101 = 0 THEN '99/99/9999' WHEN ({j}) % 97 = 0 THEN NULL "
        f"WHEN ({j}) % 10 = 0 THEN strftime({d}, '%Y-%m-%d') ELSE strftime({d}, '%d/%m/%Y') END"
    )


def _date(c: str) -> str:
    return (
        f"coalesce(CAST(try_strptime({c}, '%d/%m/%Y') AS DATE), CAST(try_strptime({c}, '%Y-%m-%d') AS DATE))"
    )


RAW = f"""
WITH base AS (
  SELECT o_orderkey AS k, o_custkey AS ck, CAST(o_orderdate AS DATE) AS d, n_name, rep,
         CASE WHEN o_orderpriority = '1-URGENT' THEN '1' WHEN o_orderpriority = '5-LOW' THEN '9' ELSE '2' END AS icu,
         CASE o_orderstatus WHEN 'F' THEN '2' WHEN 'O' THEN '1' ELSE '9' END AS outcome
  FROM orders
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  JOIN (VALUES (0), (1)) AS r(rep) ON rep = 0 OR o_orderkey % 50 = 0
),
raw AS (
  SELECT CAST(k AS VARCHAR) AS NU_NOTIFIC,
    {_mixed('(d + CAST(k % 9 - 1 + rep AS INTEGER))', 'k + 13')} AS DT_NOTIFIC,
    {_mixed('d', 'k')} AS DT_SIN_PRI,
    CAST(week(d) AS VARCHAR) AS SEM_PRI,
    CAST(year(d) AS INTEGER) AS ANO_DADOS,
    CASE WHEN ck % 20 = 0 THEN 'I' WHEN ck % 2 = 1 THEN 'M' ELSE 'F' END AS CS_SEXO,
    CAST(ck * 7 % 130 AS VARCHAR) AS NU_IDADE_N,
    CASE WHEN k % 11 = 0 THEN '2' ELSE '3' END AS TP_IDADE,
    CASE WHEN k % 89 <> 0 THEN n_name END AS SG_UF,
    CAST(ck % 300 AS VARCHAR) AS CO_MUN_RES,
    CASE k % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '9' END AS FEBRE,
    CASE k % 7 WHEN 0 THEN '9' WHEN 1 THEN '2' WHEN 2 THEN '' ELSE '1' END AS TOSSE,
    CASE k % 5 WHEN 0 THEN '2' WHEN 1 THEN '9' ELSE '1' END AS DISPNEIA,
    CASE WHEN k % 10 < 8 THEN '1' WHEN k % 10 = 8 THEN '2' ELSE '9' END AS HOSPITAL,
    icu AS UTI,
    outcome AS EVOLUCAO,
    CASE k % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '9' END AS VACINA,
    CASE WHEN k % 10 < 8 THEN strftime(d + CAST(k % 5 AS INTEGER), '%d/%m/%Y') END AS DT_INTERNA,
    CASE WHEN k % 10 < 8 AND icu = '1' THEN strftime(d + CAST(k % 5 + k % 3 AS INTEGER), '%d/%m/%Y') END AS DT_ENTUTI,
    CASE WHEN k % 10 < 8 AND outcome <> '9' THEN strftime(d + CAST(k % 5 + k % 21 - 1 AS INTEGER), '%d/%m/%Y') END AS DT_EVOLUCA
  FROM base
)"""

TYPED = f"""{RAW},
typed AS (
  SELECT NU_NOTIFIC AS nu_notific,
    {_date('DT_NOTIFIC')} AS dt_notific, {_date('DT_SIN_PRI')} AS dt_sin_pri,
    CASE WHEN TRY_CAST(SEM_PRI AS INTEGER) BETWEEN 1 AND 53 THEN TRY_CAST(SEM_PRI AS INTEGER) END AS sem_pri,
    ANO_DADOS AS ano_dados,
    CASE CS_SEXO WHEN 'M' THEN '1' WHEN 'F' THEN '2' END AS cs_sexo,
    CASE WHEN TP_IDADE = '3' THEN TRY_CAST(NU_IDADE_N AS INTEGER) END AS nu_idade_n,
    TP_IDADE AS tp_idade, SG_UF AS sg_uf, CO_MUN_RES AS co_mun_res,
    FEBRE AS febre, TOSSE AS tosse, DISPNEIA AS dispneia, HOSPITAL AS hospital,
    {_date('DT_INTERNA')} AS dt_interna, UTI AS uti, {_date('DT_ENTUTI')} AS dt_entuti,
    EVOLUCAO AS evolucao, {_date('DT_EVOLUCA')} AS dt_evoluca, VACINA AS vacina,
    CASE WHEN EVOLUCAO IN ('1', '2') THEN EVOLUCAO END AS evolucao_clean,
    CASE WHEN UTI IN ('1', '2') THEN UTI END AS uti_clean,
    CASE WHEN VACINA IN ('1', '2') THEN VACINA END AS vacina_clean,
    CASE WHEN HOSPITAL IN ('1', '2') THEN HOSPITAL END AS hospital_clean,
    CASE CS_SEXO WHEN 'M' THEN '1' WHEN 'F' THEN '2' END AS cs_sexo_clean
  FROM raw
)"""

PASS1 = "nu_notific IS NOT NULL AND dt_sin_pri IS NOT NULL AND dt_notific IS NOT NULL"
PASS2 = (
    "dt_sin_pri <= dt_notific AND (dt_interna IS NULL OR dt_sin_pri <= dt_interna) "
    "AND (dt_interna IS NULL OR dt_evoluca IS NULL OR dt_interna <= dt_evoluca)"
)
PASS3 = "(nu_idade_n IS NULL OR nu_idade_n BETWEEN 0 AND 120)"


def bands(age: str) -> str:
    return (
        f"CASE WHEN {age} < 1 THEN '0-1 ano' WHEN {age} < 5 THEN '1-4 anos' WHEN {age} < 10 THEN '5-9 anos' "
        f"WHEN {age} < 18 THEN '10-17 anos' WHEN {age} < 30 THEN '18-29 anos' WHEN {age} < 40 THEN '30-39 anos' "
        f"WHEN {age} < 50 THEN '40-49 anos' WHEN {age} < 60 THEN '50-59 anos' WHEN {age} < 70 THEN '60-69 anos' "
        f"WHEN {age} >= 70 THEN '70+ anos' ELSE 'Desconhecido' END"
    )


def coarse(age: str) -> str:
    return (
        f"CASE WHEN {age} < 18 THEN '0-17' WHEN {age} < 30 THEN '18-29' WHEN {age} < 40 THEN '30-39' "
        f"WHEN {age} < 50 THEN '40-49' WHEN {age} < 60 THEN '50-59' WHEN {age} < 70 THEN '60-69' "
        f"WHEN {age} >= 70 THEN '70+' ELSE 'Desconhecido' END"
    )


FEATURES = f"""
    CAST(year(dt_sin_pri) AS INTEGER) AS ano, CAST(month(dt_sin_pri) AS INTEGER) AS mes,
    CAST(dayofweek(dt_sin_pri) + 1 AS INTEGER) AS dia_semana, strftime(dt_sin_pri, '%Y-%m') AS ano_mes,
    CAST(dt_notific - dt_sin_pri AS INTEGER) AS tempo_sintoma_notificacao,
    CAST(dt_interna - dt_sin_pri AS INTEGER) AS tempo_sintoma_internacao,
    CAST(dt_evoluca - dt_interna AS INTEGER) AS tempo_internacao,
    {bands('nu_idade_n')} AS faixa_etaria,
    coalesce(nu_idade_n >= 60, false) AS is_idoso,
    coalesce(evolucao_clean = '2', false) AS is_obito, coalesce(evolucao_clean = '1', false) AS is_cura,
    coalesce(hospital_clean = '1', false) AS is_internado, coalesce(uti_clean = '1', false) AS is_uti,
    coalesce(vacina_clean = '1', false) AS is_vacinado, coalesce(febre = '1', false) AS has_febre,
    coalesce(tosse = '1', false) AS has_tosse, coalesce(dispneia = '1', false) AS has_dispneia,
    coalesce(dt_sin_pri <= dt_notific, false) AS _data_valida,
    ((cs_sexo_clean IS NOT NULL)::INT + (nu_idade_n IS NOT NULL)::INT
     + (evolucao_clean IS NOT NULL)::INT + (sg_uf IS NOT NULL)::INT) / 4.0::DOUBLE AS _completude_score"""

SILVER = f"""{TYPED},
passed AS (
  SELECT *, row_number() OVER (PARTITION BY nu_notific ORDER BY dt_notific, dt_sin_pri) AS rn
  FROM typed WHERE {PASS1} AND {PASS2} AND {PASS3}
),
silver AS (
  SELECT * EXCLUDE (rn), {FEATURES}
  FROM passed WHERE rn = 1
)"""


def rate(num: str, den: str, digits: int = 2) -> str:
    return f"round(({num}) * 100.0::DOUBLE / nullif({den}, 0), {digits})"


def n_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


DEATHS = n_if("evolucao_clean = '2'")
OUTCOMES = "count(evolucao_clean)"
MORTALITY = rate(DEATHS, OUTCOMES)
ADMITTED = n_if("is_internado")
ICU = n_if("is_uti")
ICU_RATE = rate(ICU, ADMITTED)
VACCINATED = n_if("is_vacinado")
VACCINE_KNOWN = "count(vacina_clean)"
VACCINATION = rate(VACCINATED, VACCINE_KNOWN)
