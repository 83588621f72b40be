"""Exploration, association and top-k queries over the case tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from episurv.functions.codes import ICU_LABELS, OUTCOME_LABELS, SEX_LABELS, VACCINE_LABELS
from episurv.functions.columns import year_month
from episurv.operators import association as assoc
from episurv.operators import explore as ex
from episurv.operators import rates as r
from episurv.operators.typing import select_available, type_cases
from episurv.plans import gold
from episurv.plans.cases import raw_cases, table
from episurv.plans.silver import silver_of
from episurv.registry import query
from episurv.registry.gold_queries import BAND_ORDER, MONTHLY
from episurv.registry.sql import MORTALITY, RAW, SILVER, TYPED, coarse, n_if, rate

@query(
    "a20_text_summary",
    f"""{SILVER} SELECT 'Total de Registros' AS metrica, CAST(count(*) AS VARCHAR) AS valor FROM silver
    UNION ALL SELECT 'Período', CAST(min(dt_sin_pri) AS VARCHAR) || ' a ' || CAST(max(dt_sin_pri) AS VARCHAR) FROM silver
    UNION ALL SELECT 'UFs Distintas', CAST(count(DISTINCT sg_uf) AS VARCHAR) FROM silver
    UNION ALL SELECT 'Idade Média', CAST(round(avg(nu_idade_n), 1) AS VARCHAR) FROM silver
    UNION ALL SELECT 'Taxa de Óbitos Geral (%)', CAST({MORTALITY} AS VARCHAR) FROM silver""",
)
def a20(spark, d):
    return ex.text_summary(silver_of(spark, d))


@query(
    "a21_top_categories",
    f"""{SILVER} SELECT sg_uf, count(*) AS casos, {rate('count(*)', '(SELECT count(*) FROM silver)')} AS percentual
    FROM silver WHERE sg_uf IS NOT NULL GROUP BY sg_uf ORDER BY casos DESC, sg_uf LIMIT 10""",
)
def a21(spark, d):
    return ex.top_categories(silver_of(spark, d), "sg_uf", 10)


@query(
    "a22_share_among_top",
    f"""{RAW}, top AS (SELECT SG_UF, count(*) AS casos, CAST(row_number() OVER (ORDER BY count(*) DESC, SG_UF) AS INTEGER) AS posicao
      FROM raw WHERE SG_UF IS NOT NULL GROUP BY SG_UF ORDER BY posicao LIMIT 15)
    SELECT SG_UF, casos, posicao, {rate('casos', 'sum(casos) OVER ()')} AS percentual,
      {rate('sum(casos) FILTER (WHERE posicao <= 5) OVER ()', 'sum(casos) OVER ()')} AS concentracao_pct FROM top""",
)
def a22(spark, d):
    return ex.share_among_top(raw_cases(spark, d), "SG_UF", 15, 5)


@query(
    "a23_band_distribution",
    f"""{TYPED}, b AS (SELECT {coarse('nu_idade_n')} AS faixa_etaria, count(*) AS casos FROM typed GROUP BY 1)
    SELECT faixa_etaria, casos, CAST(list_position(['0-17','18-29','30-39','40-49','50-59','60-69','70+'], faixa_etaria) AS INTEGER) AS ordem,
      {rate('casos', 'sum(casos) OVER ()')} AS percentual,
      {rate("sum(casos) FILTER (WHERE faixa_etaria IN ('60-69', '70+')) OVER ()", 'sum(casos) OVER ()')} AS pct_60_mais
    FROM b WHERE faixa_etaria <> 'Desconhecido'""",
)
def a23(spark, d):
    return ex.band_distribution(type_cases(select_available(raw_cases(spark, d))), "nu_idade_n")


@query(
    "a24_completeness_levels",
    f"""{SILVER} SELECT CASE WHEN _completude_score = 1.0 THEN 'Completo (100%)' WHEN _completude_score >= 0.75 THEN 'Bom (75-99%)'
      WHEN _completude_score >= 0.5 THEN 'Médio (50-74%)' ELSE 'Baixo (<50%)' END AS nivel_completude, count(*) AS casos,
      {rate('count(*)', '(SELECT count(*) FROM silver)')} AS percentual FROM silver GROUP BY 1""",
)
def a24(spark, d):
    return ex.completeness_levels(silver_of(spark, d))


@query(
    "a25_event_times",
    f"{SILVER} " + " UNION ALL ".join(
        f"SELECT '{name}' AS evento, round(avg({gap}), 1) AS media_dias, round(quantile_cont({gap}, 0.5), 1) AS mediana_dias FROM silver"
        for name, gap in ex.GAP_EVENTS
    ),
)
def a25(spark, d):
    return ex.event_times(silver_of(spark, d))


@query(
    "a26_mortality_by_file_year",
    f"""{RAW} SELECT ANO_DADOS, {n_if("EVOLUCAO = '1'")} AS curas, {n_if("EVOLUCAO = '2'")} AS obitos,
    {rate(n_if("EVOLUCAO = '2'"), 'count(*)')} AS taxa_mortalidade FROM raw WHERE EVOLUCAO IN ('1', '2') GROUP BY ANO_DADOS""",
)
def a26(spark, d):
    return ex.mortality_by_file_year(raw_cases(spark, d))


def _dist(var: str, labels: dict, where: str = "true") -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
    return (
        f"SELECT '{var}' AS variavel, {var} AS codigo, CASE {var} {cases} END AS label, count(*) AS casos, "
        f"{rate('count(*)', 'sum(count(*)) OVER ()')} AS percentual FROM raw WHERE {var} IN ('1', '2') AND {where} GROUP BY {var}"
    )


@query(
    "a27_code_distributions",
    f"""{RAW} {_dist('CS_SEXO', SEX_LABELS)} UNION ALL {_dist('EVOLUCAO', OUTCOME_LABELS)}
    UNION ALL {_dist('UTI', ICU_LABELS, "HOSPITAL = '1'")} UNION ALL {_dist('VACINA', VACCINE_LABELS)}""",
)
def a27(spark, d):
    return ex.code_distributions(
        raw_cases(spark, d),
        [
            ("CS_SEXO", SEX_LABELS, None),
            ("EVOLUCAO", OUTCOME_LABELS, None),
            ("UTI", ICU_LABELS, F.col("HOSPITAL") == "1"),
            ("VACINA", VACCINE_LABELS, None),
        ],
    )


@query(
    "a28_contingency",
    "SELECT l_returnflag AS valor1, l_linestatus AS valor2, count(*) AS casos FROM lineitem GROUP BY 1, 2",
)
def a28(spark, d):
    return assoc.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


def _v_sql(cells: str, by: str = "") -> str:
    """Textbook form: expected counts over the full grid of margins, Yates on 2x2."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"
    return f"""{cells},
    rowsum AS (SELECT {keys}valor1, sum(casos) AS r FROM cells GROUP BY {keys}valor1),
    colsum AS (SELECT {keys}valor2, sum(casos) AS c FROM cells GROUP BY {keys}valor2),
    grid AS (SELECT *, sum(r) OVER ({part + ',' if part else 'PARTITION BY'} valor2) AS n FROM rowsum JOIN colsum {using}),
    dims AS (SELECT {keys}count(DISTINCT valor1) AS niveis1, count(DISTINCT valor2) AS niveis2, any_value(n) AS n FROM grid
      {'GROUP BY ' + by if by else ''}),
    dev AS (SELECT {', '.join('g.' + k.strip() for k in by.split(',')) + ', ' if by else ''}r::DOUBLE * c / n AS e,
        abs(coalesce(k.casos, 0) - r::DOUBLE * c / n) AS diff
      FROM grid g LEFT JOIN cells k USING ({keys}valor1, valor2)),
    chi AS (SELECT {keys}sum(diff * diff / e) AS plain, sum(pow(diff - least(0.5, diff), 2) / e) AS yates FROM dev
      {'GROUP BY ' + by if by else ''})
    SELECT {keys}CAST(n AS BIGINT) AS casos, niveis1, niveis2, round(CASE WHEN least(niveis1, niveis2) < 2 THEN 0
      ELSE sqrt(CASE WHEN niveis1 = 2 AND niveis2 = 2 THEN yates ELSE plain END / (n * (least(niveis1, niveis2) - 1))) END, 6) AS cramers_v
    FROM dims JOIN chi {using}"""


@query(
    "a29_cramers_v_labels",
    _v_sql("WITH cells AS (SELECT quality AS valor1, toxic AS valor2, count(*) AS casos FROM labels GROUP BY 1, 2)"),
)
def a29_labels(spark, d):
    return assoc.cramers_v(table(spark, d, "labels"), "quality", "toxic")


@query(
    "a29_cramers_v_lineitem",
    _v_sql("WITH cells AS (SELECT l_returnflag AS valor1, l_linestatus AS valor2, count(*) AS casos FROM lineitem GROUP BY 1, 2)"),
)
def a29_lineitem(spark, d):
    return assoc.cramers_v(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


_VARS = ["CS_SEXO", "FEBRE", "TOSSE", "DISPNEIA", "HOSPITAL", "UTI", "EVOLUCAO"]
_PAIR_CELLS = f"""{RAW}, cells AS ({' UNION ALL '.join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, {a} AS valor1, {b} AS valor2, count(*) AS casos FROM raw "
    f"WHERE {a} <> '9' AND {b} <> '9' GROUP BY {a}, {b}" for a, b in combinations(_VARS, 2))})"""


@query("a30_association_matrix", _v_sql(_PAIR_CELLS, "var1, var2"))
def a30(spark, d):
    return assoc.association_matrix(raw_cases(spark, d))


@query(
    "a30_strong_pairs",
    f"""SELECT *, CASE WHEN cramers_v >= 0.4 THEN 'FORTE' ELSE 'MODERADA' END AS interpretacao
    FROM ({_v_sql(_PAIR_CELLS, "var1, var2")}) WHERE cramers_v > 0.01""",
)
def a30_strong(spark, d):
    return assoc.strong_pairs(raw_cases(spark, d), above=0.01)


_MISSING = [c for c in ex.MISSING_FIELDS if c not in ("SATURACAO", "VACINA_COV")]


@query(
    "a31_missing_fields",
    f"{RAW} " + " UNION ALL ".join(
        f"SELECT '{c}' AS campo, {n_if(f'''{c} IS NULL OR {c} = '' ''')} AS missing_count, "
        f"round({n_if(f'''{c} IS NULL OR {c} = '' ''')}::DOUBLE / count(*) * 100, 2) AS missing_pct FROM raw"
        for c in _MISSING
    ),
)
def a31(spark, d):
    return ex.missing_fields(raw_cases(spark, d))


_CODE9 = ["FEBRE", "TOSSE", "DISPNEIA", "HOSPITAL", "UTI", "EVOLUCAO", "VACINA"]


@query(
    "a32_ignored_codes",
    f"""{RAW}, c AS ({' UNION ALL '.join(f'''SELECT '{c}' AS field, {n_if(f"{c} = '9'")} AS code9_count, count(*) AS n FROM raw''' for c in _CODE9)})
    SELECT field, code9_count, round(code9_count::DOUBLE / n * 100, 2) AS code9_pct,
      CASE WHEN code9_count::DOUBLE / n * 100 > 20 THEN 'HIGH' WHEN code9_count::DOUBLE / n * 100 > 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity
    FROM c""",
)
def a32(spark, d):
    return ex.ignored_codes(raw_cases(spark, d))


@query(
    "a33_monthly_statistics",
    f"""{TYPED}, m AS (SELECT strftime(dt_sin_pri, '%Y-%m') AS ano_mes, count(*) AS casos FROM typed WHERE dt_sin_pri IS NOT NULL GROUP BY 1),
    g AS (SELECT *, (casos - lag(casos) OVER (ORDER BY ano_mes)) * 100.0::DOUBLE / nullif(lag(casos) OVER (ORDER BY ano_mes), 0) AS growth FROM m)
    SELECT round(avg(casos), 2) AS media_mensal, median(casos) AS mediana_mensal,
      (SELECT ano_mes FROM m ORDER BY casos DESC, ano_mes LIMIT 1) AS mes_maximo, max(casos) AS casos_maximo,
      (SELECT ano_mes FROM m ORDER BY casos, ano_mes LIMIT 1) AS mes_minimo, min(casos) AS casos_minimo,
      round(avg(growth), 2) AS crescimento_medio, round(max(growth), 2) AS crescimento_maximo, round(min(growth), 2) AS crescimento_minimo
    FROM g""",
)
def a33(spark, d):
    typed = type_cases(select_available(raw_cases(spark, d)))
    return ex.monthly_statistics(ex.monthly_counts(typed, year_month("dt_sin_pri")))


@query(
    "a34_seasonality",
    f"""{RAW} SELECT SEM_PRI, round(avg(casos), 2) AS media_casos FROM
    (SELECT SEM_PRI, ANO_DADOS, count(*) AS casos FROM raw WHERE SEM_PRI IS NOT NULL GROUP BY 1, 2)
    GROUP BY SEM_PRI ORDER BY media_casos DESC, SEM_PRI LIMIT 5""",
)
def a34(spark, d):
    return ex.seasonality(raw_cases(spark, d))


@query(
    "a35_recent_days",
    f"""{TYPED}, day AS (SELECT dt_sin_pri, count(*) AS casos FROM typed WHERE dt_sin_pri >= DATE '2001-08-01' - 90 GROUP BY 1)
    SELECT CAST(min(dt_sin_pri) AS VARCHAR) AS inicio, CAST(max(dt_sin_pri) AS VARCHAR) AS fim, CAST(sum(casos) AS BIGINT) AS total,
      round(avg(casos), 1) AS media_diaria, max(casos) AS maximo_diario,
      (SELECT CAST(dt_sin_pri AS VARCHAR) FROM day ORDER BY casos DESC, dt_sin_pri LIMIT 1) AS dia_maximo FROM day""",
)
def a35(spark, d):
    return ex.recent_days(type_cases(select_available(raw_cases(spark, d))), 90, "2001-08-01")


# --- sort, limit, joins, sets -----------------------------------------------------------------


@query("t1_newest_months", f"{SILVER}, {MONTHLY} SELECT ano_mes, total_casos, taxa_mortalidade, taxa_uti, taxa_vacinacao, taxa_crescimento FROM monthly_metrics ORDER BY ano_mes DESC LIMIT 12")
def t1(spark, d):
    return (
        gold.monthly_metrics(silver_of(spark, d), key_is_unique=True)
        .orderBy(F.desc("ano_mes"))
        .limit(12)
        .select("ano_mes", "total_casos", "taxa_mortalidade", "taxa_uti", "taxa_vacinacao", "taxa_crescimento")
    )


@query(
    "t2_ordinal_order",
    f"""{SILVER} SELECT faixa_etaria, casos, taxa_mortalidade, CAST(row_number() OVER (ORDER BY list_position({BAND_ORDER}, faixa_etaria)) AS INTEGER) AS linha
    FROM (SELECT faixa_etaria, count(*) AS casos, round(avg(CASE WHEN is_obito THEN 100.0::DOUBLE ELSE 0 END), 2) AS taxa_mortalidade
    FROM silver WHERE faixa_etaria <> 'Desconhecido' GROUP BY faixa_etaria)""",
)
def t2(spark, d):
    from pyspark.sql import Window

    from episurv.functions.codes import AGE_BANDS
    from episurv.functions.columns import ordinal

    ordered = ex.in_band_order(ex.band_mortality(silver_of(spark, d)))
    position = Window.orderBy(ordinal("faixa_etaria", [label for _, label in AGE_BANDS]))
    return ordered.withColumn("linha", F.row_number().over(position))


@query("t3_newest_24_months", f"{SILVER}, {MONTHLY} SELECT ano_mes, total_casos, tempo_medio_notificacao, tempo_medio_internacao FROM monthly_metrics ORDER BY ano_mes DESC LIMIT 24")
def t3(spark, d):
    return (
        gold.monthly_metrics(silver_of(spark, d), key_is_unique=True)
        .orderBy(F.desc("ano_mes"))
        .limit(24)
        .select("ano_mes", "total_casos", "tempo_medio_notificacao", "tempo_medio_internacao")
    )


@query(
    "t6_sample_rows",
    f"""{RAW} SELECT NU_NOTIFIC, DT_NOTIFIC, DT_SIN_PRI, CS_SEXO, SG_UF, EVOLUCAO FROM raw
    ORDER BY CAST(NU_NOTIFIC AS BIGINT), DT_NOTIFIC LIMIT 5""",
)
def t6(spark, d):
    wanted = {"essenciais": ["NU_NOTIFIC", "DT_NOTIFIC", "DT_SIN_PRI", "CS_SEXO", "NU_CPF", "SG_UF", "EVOLUCAO"]}
    return (
        select_available(raw_cases(spark, d), wanted)
        .orderBy(F.col("NU_NOTIFIC").cast("bigint"), F.col("DT_NOTIFIC").asc_nulls_last())
        .limit(5)
    )


@query("j2_share_of_grand_total", f"{SILVER} SELECT sg_uf, count(*) AS casos, {rate('count(*)', '(SELECT count(*) FROM silver)')} AS percentual FROM silver GROUP BY sg_uf")
def j2(spark, d):
    from episurv.operators.series import with_share

    return with_share(silver_of(spark, d).groupBy("sg_uf").agg(r.rows().alias("casos")), "casos")


@query("u4_distinct_values", f"{RAW} SELECT (SELECT count(*) FROM (SELECT DISTINCT VACINA FROM raw)) AS distintos, (SELECT count(DISTINCT VACINA) FROM raw) AS sem_nulo")
def u4(spark, d):
    from episurv.operators.quality import distinct_values

    return raw_cases(spark, d).agg(
        distinct_values("VACINA").alias("distintos"), F.count_distinct("VACINA").alias("sem_nulo")
    )


@query(
    "x1_period_text",
    f"{SILVER} SELECT ano_mes, CAST(min(dt_sin_pri) AS VARCHAR) || ' a ' || CAST(max(dt_sin_pri) AS VARCHAR) AS periodo, lpad(CAST(min(dia_semana) AS VARCHAR), 2, '0') AS primeiro FROM silver GROUP BY ano_mes",
)
def x1(spark, d):
    return silver_of(spark, d).groupBy("ano_mes").agg(
        F.concat(F.min("dt_sin_pri").cast("string"), F.lit(" a "), F.max("dt_sin_pri").cast("string")).alias("periodo"),
        F.lpad(F.min("dia_semana").cast("string"), 2, "0").alias("primeiro"),
    )
