"""Typing, projection, derived columns and filters on the notification records."""

from __future__ import annotations

from pyspark.sql import functions as F

from episurv.functions.codes import AGE_BANDS_COARSE, OUTCOME_LABELS, SEX_LABELS, SEX_UNKNOWN
from episurv.functions.columns import (
    age_years, band, int_in_range, ordinal, parse_date_multi, recode,
)
from episurv.operators import filters as flt
from episurv.operators import typing as typ
from episurv.plans.cases import raw_cases
from episurv.plans.silver import silver_of, typed_cases
from episurv.registry import query
from episurv.registry.sql import FEATURES, PASS1, PASS2, PASS3, RAW, SILVER, TYPED, coarse

ID = ["NU_NOTIFIC", "DT_NOTIFIC"]
RAW_DATES = ["DT_NOTIFIC", "DT_SIN_PRI", "DT_INTERNA", "DT_ENTUTI", "DT_EVOLUCA"]


@query("cases_raw", f"{RAW} SELECT * FROM raw")
def cases_raw(spark, d):
    return raw_cases(spark, d)


@query(
    "p1_select_available",
    f"""{RAW} SELECT NU_NOTIFIC, DT_NOTIFIC, DT_SIN_PRI, SEM_PRI, ANO_DADOS, CS_SEXO, NU_IDADE_N, TP_IDADE, SG_UF,
    CO_MUN_RES, FEBRE, TOSSE, DISPNEIA, HOSPITAL, DT_INTERNA, UTI, DT_ENTUTI, EVOLUCAO, DT_EVOLUCA, VACINA FROM raw""",
)
def p1(spark, d):
    return typ.select_available(raw_cases(spark, d))


@query(
    "p2_parse_date_multi",
    f"""{RAW} SELECT r.NU_NOTIFIC, r.DT_NOTIFIC,
    {', '.join(f"CAST(coalesce(CAST(try_strptime(r.{c}, '%d/%m/%Y') AS DATE), CAST(try_strptime(r.{c}, '%Y-%m-%d') AS DATE)) AS VARCHAR) AS {c.lower()}_data" for c in RAW_DATES)}
    FROM raw r""",
)
def p2(spark, d):
    return raw_cases(spark, d).select(*ID, *[parse_date_multi(c).alias(f"{c.lower()}_data") for c in RAW_DATES])


@query(
    "p3_age_years",
    f"""{RAW} SELECT NU_NOTIFIC, DT_NOTIFIC, TP_IDADE, NU_IDADE_N,
    CASE WHEN TP_IDADE = '3' THEN TRY_CAST(NU_IDADE_N AS INTEGER) END AS idade_anos FROM raw""",
)
def p3(spark, d):
    return raw_cases(spark, d).select(
        *ID, "TP_IDADE", "NU_IDADE_N", age_years("NU_IDADE_N", "TP_IDADE").alias("idade_anos")
    )


@query(
    "p4_int_in_range",
    f"""{RAW} SELECT NU_NOTIFIC, DT_NOTIFIC, CASE WHEN CAST(SEM_PRI AS INTEGER) BETWEEN 1 AND 53 THEN CAST(SEM_PRI AS INTEGER) END AS semana,
    CASE WHEN TRY_CAST(TOSSE AS INTEGER) BETWEEN 1 AND 2 THEN TRY_CAST(TOSSE AS INTEGER) END AS tosse_1_2 FROM raw""",
)
def p4(spark, d):
    return raw_cases(spark, d).select(
        *ID, int_in_range("SEM_PRI", 1, 53).alias("semana"), int_in_range("TOSSE", 1, 2).alias("tosse_1_2")
    )


@query("p5_recode", f"{RAW} SELECT NU_NOTIFIC, DT_NOTIFIC, CS_SEXO, CASE CS_SEXO WHEN 'M' THEN '1' WHEN 'F' THEN '2' END AS sexo FROM raw")
def p5(spark, d):
    return raw_cases(spark, d).select(*ID, "CS_SEXO", recode("CS_SEXO", {"M": "1", "F": "2"}).alias("sexo"))


TYPED_OUT = """nu_notific, CAST(dt_notific AS VARCHAR) AS dt_notific, CAST(dt_sin_pri AS VARCHAR) AS dt_sin_pri, sem_pri,
ano_dados, cs_sexo, nu_idade_n, tp_idade, sg_uf, co_mun_res, febre, tosse, dispneia, hospital,
CAST(dt_interna AS VARCHAR) AS dt_interna, uti, CAST(dt_entuti AS VARCHAR) AS dt_entuti, evolucao,
CAST(dt_evoluca AS VARCHAR) AS dt_evoluca, vacina"""
CLEAN_OUT = "evolucao_clean, uti_clean, vacina_clean, hospital_clean, cs_sexo_clean"
FEATURE_OUT = """ano, mes, dia_semana, ano_mes, tempo_sintoma_notificacao, tempo_sintoma_internacao, tempo_internacao,
faixa_etaria, is_idoso, is_obito, is_cura, is_internado, is_uti, is_vacinado, has_febre, has_tosse, has_dispneia,
_data_valida, _completude_score"""


@query("p6_typed_lower_names", f"{TYPED} SELECT {TYPED_OUT} FROM typed")
def p6(spark, d):
    return typ.type_cases(typ.select_available(raw_cases(spark, d)))


@query("p7_valid_only", f"{TYPED} SELECT nu_notific, CAST(dt_notific AS VARCHAR) AS dt_notific, evolucao, uti, vacina, hospital, cs_sexo, {CLEAN_OUT} FROM typed")
def p7(spark, d):
    return typed_cases(raw_cases(spark, d)).select(
        "nu_notific", "dt_notific", "evolucao", "uti", "vacina", "hospital", "cs_sexo",
        *[f"{c}_clean" for c in ("evolucao", "uti", "vacina", "hospital", "cs_sexo")],
    )


def _features_sql(*names: str) -> str:
    return f"""{TYPED}, f AS (SELECT *, {FEATURES} FROM typed)
    SELECT nu_notific, CAST(dt_notific AS VARCHAR) AS dt_notific, {', '.join(names)} FROM f"""


@query("p8_date_parts", _features_sql("ano", "mes", "dia_semana", "ano_mes"))
def p8(spark, d):
    return typ.add_date_parts(typed_cases(raw_cases(spark, d))).select(
        "nu_notific", "dt_notific", "ano", "mes", "dia_semana", "ano_mes"
    )


GAPS = ["tempo_sintoma_notificacao", "tempo_sintoma_internacao", "tempo_internacao"]


@query("p9_day_gaps", _features_sql(*GAPS))
def p9(spark, d):
    return typ.add_day_gaps(typed_cases(raw_cases(spark, d))).select("nu_notific", "dt_notific", *GAPS)


@query("p10_age_band", _features_sql("nu_idade_n", "faixa_etaria", "is_idoso"))
def p10(spark, d):
    return typ.add_age_features(typed_cases(raw_cases(spark, d))).select(
        "nu_notific", "dt_notific", "nu_idade_n", "faixa_etaria", "is_idoso"
    )


@query("p11_age_band_coarse", f"{TYPED} SELECT nu_notific, CAST(dt_notific AS VARCHAR) AS dt_notific, nu_idade_n, {coarse('nu_idade_n')} AS faixa FROM typed")
def p11(spark, d):
    return typed_cases(raw_cases(spark, d)).select(
        "nu_notific", "dt_notific", "nu_idade_n", band("nu_idade_n", AGE_BANDS_COARSE).alias("faixa")
    )


FLAGS = ["is_obito", "is_cura", "is_internado", "is_uti", "is_vacinado", "has_febre", "has_tosse", "has_dispneia"]


@query("p12_flags", _features_sql(*FLAGS))
def p12(spark, d):
    return typ.add_flags(typed_cases(raw_cases(spark, d))).select("nu_notific", "dt_notific", *FLAGS)


@query("p13_valid_dates_flag", _features_sql("_data_valida"))
def p13(spark, d):
    return typ.add_quality_flags(typed_cases(raw_cases(spark, d))).select("nu_notific", "dt_notific", "_data_valida")


@query("p14_completeness_score", _features_sql("_completude_score"))
def p14(spark, d):
    return typ.add_quality_flags(typed_cases(raw_cases(spark, d))).select(
        "nu_notific", "dt_notific", "_completude_score"
    )


@query("p15_lineage", f"{TYPED} SELECT nu_notific, CAST(dt_notific AS VARCHAR) AS dt_notific, 'run-1' AS _process_id, ano_dados AS _source_year, true AS has_time FROM typed")
def p15(spark, d):
    out = typ.add_lineage(typed_cases(raw_cases(spark, d)), "run-1", "silver")
    return out.select(
        "nu_notific", "dt_notific", "_process_id", "_source_year",
        F.col("_silver_processed_at").isNotNull().alias("has_time"),
    )


@query(
    "p16_labels_and_ordinal",
    f"""{TYPED} SELECT nu_notific, CAST(dt_notific AS VARCHAR) AS dt_notific,
    CASE cs_sexo_clean WHEN '1' THEN 'Masculino' WHEN '2' THEN 'Feminino' ELSE 'Não informado' END AS sexo_label,
    CASE evolucao_clean WHEN '1' THEN 'Cura' WHEN '2' THEN 'Óbito' END AS desfecho_label,
    coalesce(CAST(list_position(['0-17','18-29','30-39','40-49','50-59','60-69','70+'], {coarse('nu_idade_n')}) AS INTEGER), 99) AS ordem
    FROM typed""",
)
def p16(spark, d):
    return typed_cases(raw_cases(spark, d)).select(
        "nu_notific", "dt_notific",
        recode("cs_sexo_clean", SEX_LABELS, SEX_UNKNOWN).alias("sexo_label"),
        recode("evolucao_clean", OUTCOME_LABELS).alias("desfecho_label"),
        ordinal(band("nu_idade_n", AGE_BANDS_COARSE), [label for _, label in AGE_BANDS_COARSE]).alias("ordem"),
    )


@query(
    "p17_sample",
    f"""{RAW} SELECT NU_NOTIFIC, DT_NOTIFIC FROM raw
    WHERE CAST(CAST('0x' || substr(md5('42:' || NU_NOTIFIC), 1, 8) AS BIGINT) AS DOUBLE) < 0.1 * 4294967296.0""",
)
def p17(spark, d):
    return typ.sample_rows(raw_cases(spark, d).select(*ID), 0.1, seed=42, key="NU_NOTIFIC")


@query(
    "p18_pad_to_schema",
    f"{RAW} SELECT NU_NOTIFIC, CAST(NULL AS VARCHAR) AS CS_RACA, CAST(NULL AS INTEGER) AS DOSE_1_COV, CAST(ANO_DADOS AS BIGINT) AS ANO_DADOS FROM raw",
)
def p18(spark, d):
    return typ.pad_to_schema(
        raw_cases(spark, d), {"NU_NOTIFIC": "string", "CS_RACA": "string", "DOSE_1_COV": "int", "ANO_DADOS": "bigint"}
    )


@query("f1_required", f"{TYPED} SELECT {TYPED_OUT} FROM typed WHERE {PASS1}")
def f1(spark, d):
    return typ.type_cases(typ.select_available(raw_cases(spark, d))).filter(flt.filled())


@query("f2_ordered_dates", f"{TYPED} SELECT {TYPED_OUT} FROM typed WHERE {PASS2}")
def f2(spark, d):
    return typ.type_cases(typ.select_available(raw_cases(spark, d))).filter(flt.ordered_dates())


@query("f3_range_or_null", f"{TYPED} SELECT {TYPED_OUT} FROM typed WHERE {PASS3}")
def f3(spark, d):
    return typ.type_cases(typ.select_available(raw_cases(spark, d))).filter(flt.range_or_null("nu_idade_n", 0, 120))


@query("f4_dedupe", f"{SILVER} SELECT {TYPED_OUT}, {CLEAN_OUT} FROM silver")
def f4(spark, d):
    return flt.apply_quality_filters(typed_cases(raw_cases(spark, d)))


@query("silver_table", f"{SILVER} SELECT {TYPED_OUT}, {CLEAN_OUT}, {FEATURE_OUT} FROM silver")
def silver_table(spark, d):
    return silver_of(spark, d)


_STEP = "SELECT {i} AS ordem, '{name}' AS filtro, {a} AS entrada, {b} AS saida, n0, n4 FROM n"


@query(
    "f5_filter_funnel",
    f"""{TYPED}, n AS (SELECT count(*) AS n0, count(*) FILTER (WHERE {PASS1}) AS n1,
      count(*) FILTER (WHERE {PASS1} AND {PASS2}) AS n2, count(*) FILTER (WHERE {PASS1} AND {PASS2} AND {PASS3}) AS n3,
      count(DISTINCT nu_notific) FILTER (WHERE {PASS1} AND {PASS2} AND {PASS3}) AS n4 FROM typed),
    steps AS ({' UNION ALL '.join(_STEP.format(i=i, name=x, a=f'n{i-1}', b=f'n{i}') for i, x in enumerate(
        ['campos_obrigatorios', 'consistencia_temporal', 'idade_valida', 'duplicatas'], 1))})
    SELECT ordem, filtro, entrada, saida, entrada - saida AS excluidos,
      round((entrada - saida) * 100.0::DOUBLE / n0, 2) AS excluidos_pct,
      round((n0 - n4)::DOUBLE / n0 * 100.0, 2) AS perda_total_pct, (n0 - n4)::DOUBLE / n0 * 100.0 < 40 AS perda_aceitavel
    FROM steps""",
)
def f5(spark, d):
    return flt.filter_funnel(typed_cases(raw_cases(spark, d)))


@query(
    "f6_last_days",
    f"{TYPED} SELECT nu_notific, CAST(dt_notific AS VARCHAR) AS dt_notific, CAST(dt_sin_pri AS VARCHAR) AS dt_sin_pri FROM typed WHERE dt_sin_pri >= DATE '2001-08-01' - 90",
)
def f6(spark, d):
    return (
        typed_cases(raw_cases(spark, d))
        .filter(flt.since_days("dt_sin_pri", 90, "2001-08-01"))
        .select("nu_notific", "dt_notific", "dt_sin_pri")
    )


@query(
    "f7_known_category",
    f"{SILVER} SELECT nu_notific, sg_uf, faixa_etaria FROM silver WHERE sg_uf IS NOT NULL AND faixa_etaria <> 'Desconhecido'",
)
def f7(spark, d):
    return (
        silver_of(spark, d)
        .filter(F.col("sg_uf").isNotNull() & flt.known_category("faixa_etaria"))
        .select("nu_notific", "sg_uf", "faixa_etaria")
    )


@query("f8_in_codes", f"{RAW} SELECT NU_NOTIFIC, DT_NOTIFIC, HOSPITAL, UTI FROM raw WHERE HOSPITAL = '1' AND UTI IN ('1', '2')")
def f8(spark, d):
    return raw_cases(spark, d).filter(flt.in_codes({"HOSPITAL": ["1"], "UTI": ["1", "2"]})).select(*ID, "HOSPITAL", "UTI")


@query(
    "f9_equality_filters",
    "SELECT doc_id, 'documents' AS source_table, lang AS semantic_type, source AS uf FROM documents WHERE lang = 'en' AND source = 'src7'",
)
def f9(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", F.lit("documents").alias("source_table"), F.col("lang").alias("semantic_type"), F.col("source").alias("uf")
    )
    return flt.equality_filters(docs, {"semantic_type": "en'", "uf": " src7;", "unknown": "x"})
