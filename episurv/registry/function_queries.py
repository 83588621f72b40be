"""Scalar functions and set operations in use, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from episurv.functions.codes import SEX_LABELS
from episurv.functions.columns import rate
from episurv.functions.documents import fixed, thousands
from episurv.operators import explore as ex
from episurv.operators.typing import pad_to_schema
from episurv.plans import gold
from episurv.plans.cases import raw_cases, table
from episurv.plans.silver import silver_of, written_silver
from episurv.registry import query
from episurv.registry.gold_queries import DAILY, SERIES, WEEKLY
from episurv.registry.sql import RAW, SILVER, n_if
from episurv.registry.sql import rate as sql_rate


@query("u2_union_strict", f"{SILVER}, {DAILY}, {WEEKLY}, {SERIES} SELECT * FROM series")
def u2(spark, d):
    """The two grains padded to one schema and united by name."""
    silver = written_silver(spark, d)
    daily = gold.daily_series(silver).select(
        "*", F.col("dt_sin_pri").alias("data_referencia"), F.year("dt_sin_pri").alias("ano"), F.lit("diaria").alias("tipo_agregacao")
    )
    weekly = gold.weekly_series(silver).select("*", F.col("data_inicio_semana").alias("data_referencia"), F.lit("semanal").alias("tipo_agregacao"))
    return pad_to_schema(daily, gold.SERIES_SCHEMA).unionByName(pad_to_schema(weekly, gold.SERIES_SCHEMA))


@query(
    "u3_union_all_of_metric_rows",
    f"""{SILVER} SELECT 'obitos' AS metrica, ano, {n_if('is_obito')} AS valor FROM silver GROUP BY ano
    UNION ALL SELECT 'uti', ano, {n_if('is_uti')} FROM silver GROUP BY ano
    UNION ALL SELECT 'total', ano, count(*) FROM silver GROUP BY ano""",
)
def u3(spark, d):
    """One pass and an unpivot in place of one scan per metric."""
    wide = silver_of(spark, d).groupBy("ano").agg(
        F.count_if("is_obito").alias("obitos"), F.count_if("is_uti").alias("uti"), F.count(F.lit(1)).alias("total")
    )
    return wide.unpivot(["ano"], ["obitos", "uti", "total"], "metrica", "valor")


@query(
    "x3_number_formats",
    f"""{SILVER} SELECT ano_mes, format('{{:,}}', count(*) * 1000) AS milhares,
    printf('%.2f', {sql_rate('count(evolucao_clean)', 'count(*)')}) AS taxa, printf('%+.2f', {sql_rate('count(evolucao_clean)', 'count(*)')} - 50) AS com_sinal
    FROM silver GROUP BY ano_mes""",
)
def x3(spark, d):
    share = rate(F.count("evolucao_clean"), F.count(F.lit(1)))
    return silver_of(spark, d).groupBy("ano_mes").agg(
        thousands(F.count(F.lit(1)) * 1000).alias("milhares"), fixed(share).alias("taxa"), fixed(share - 50, signed=True).alias("com_sinal")
    )


@query(
    "x6_regex_functions",
    """SELECT doc_id, regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS tem_telefone, regexp_extract(text, '([a-z]+)@([a-z.]+)', 2) AS dominio,
    CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS INTEGER) AS iniciais, md5(regexp_replace(text, '[aeiou]+', '_', 'g')) AS mascarado FROM documents""",
)
def x6(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        F.col("text").rlike("[0-9]{3}-[0-9]{4}").alias("tem_telefone"),
        F.regexp_extract("text", "([a-z]+)@([a-z.]+)", 2).alias("dominio"),
        F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("iniciais"),
        F.md5(F.regexp_replace("text", "[aeiou]+", "_")).alias("mascarado"),
    )


@query(
    "x7_date_functions",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS dia, CAST(year(ts) AS INTEGER) AS ano, CAST(month(ts) AS INTEGER) AS mes,
    CAST(dayofweek(ts) + 1 AS INTEGER) AS dia_semana, CAST(DATE '2024-01-31' - CAST(ts AS DATE) AS INTEGER) AS dias_atras,
    CAST(CAST(ts AS DATE) - 90 AS VARCHAR) AS corte, ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AS recente FROM events""",
)
def x7(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").select(
        "event_id", day.alias("dia"), F.year("ts").alias("ano"), F.month("ts").alias("mes"), F.dayofweek("ts").alias("dia_semana"),
        F.datediff(F.to_date(F.lit("2024-01-31")), day).alias("dias_atras"), F.date_sub(day, 90).alias("corte"),
        (F.col("ts") >= F.lit("2024-01-31").cast("timestamp_ntz") - F.make_dt_interval(F.lit(7))).alias("recente"),
    )


@query(
    "x8_math_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_quantity, 0) AS unitario, sqrt(l_extendedprice) AS raiz,
    greatest(0.02, least(0.08, l_discount)) AS limitado FROM lineitem""",
)
def x8(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.try_divide("l_extendedprice", F.nullif("l_quantity", F.lit(0.0))).alias("unitario"),
        F.sqrt("l_extendedprice").alias("raiz"),
        F.greatest(F.lit(0.02), F.least(F.lit(0.08), F.col("l_discount"))).alias("limitado"),
    )


@query(
    "x9_conditional_functions",
    f"""{RAW} SELECT NU_NOTIFIC, DT_NOTIFIC, CASE WHEN VACINA IN ('1', '2') THEN 'informada' WHEN VACINA IS NULL THEN 'ausente' ELSE 'ignorada' END AS vacina,
    coalesce(SG_UF, 'BR') AS uf, CAST(NU_IDADE_N AS INTEGER) BETWEEN 0 AND 120 AS idade_valida FROM raw""",
)
def x9(spark, d):
    return raw_cases(spark, d).select(
        "NU_NOTIFIC", "DT_NOTIFIC",
        F.when(F.col("VACINA").isin("1", "2"), "informada").when(F.col("VACINA").isNull(), "ausente").otherwise("ignorada").alias("vacina"),
        F.coalesce("SG_UF", F.lit("BR")).alias("uf"),
        F.col("NU_IDADE_N").cast("int").between(0, 120).alias("idade_valida"),
    )


@query(
    "a27_sex_distribution",
    f"""{SILVER} SELECT 'cs_sexo' AS variavel, cs_sexo AS codigo, CASE cs_sexo WHEN '1' THEN 'Masculino' ELSE 'Feminino' END AS label, count(*) AS casos,
    {sql_rate('count(*)', 'sum(count(*)) OVER ()')} AS percentual FROM silver WHERE cs_sexo IN ('1', '2') GROUP BY cs_sexo""",
)
def a27_sex(spark, d):
    return ex.code_distributions(silver_of(spark, d), [("cs_sexo", SEX_LABELS, None)])
