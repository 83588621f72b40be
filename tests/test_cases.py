"""Silver and gold on small frames: hazards of the semantics."""

import datetime

from pyspark.sql import functions as F

from episurv.operators import explore
from episurv.operators.filters import (
    apply_quality_filters, equality_filters, filter_funnel, first_per_key, known_category, range_or_null, since_days,
)
from episurv.operators.rates import growth, strict_icu_rate
from episurv.operators.typing import column_report, pad_to_schema, sample_rows, select_available, selected_names, type_cases
from episurv.plans import gold, views
from episurv.plans.cases import raw_cases
from episurv.plans.silver import silver_cases, typed_cases

SF = "/root/testdata/sf0.001"
RAW = (
    "NU_NOTIFIC string, DT_NOTIFIC string, DT_SIN_PRI string, SEM_PRI string, ANO_DADOS int, CS_SEXO string, NU_IDADE_N string, "
    "TP_IDADE string, SG_UF string, CO_MUN_RES string, FEBRE string, TOSSE string, DISPNEIA string, HOSPITAL string, UTI string, "
    "EVOLUCAO string, VACINA string, DT_INTERNA string, DT_EVOLUCA string"
)


def case(n, notified="02/01/2024", symptom="01/01/2024", **extra):
    row = dict(
        NU_NOTIFIC=n, DT_NOTIFIC=notified, DT_SIN_PRI=symptom, SEM_PRI="1", ANO_DADOS=2024, CS_SEXO="M", NU_IDADE_N="30",
        TP_IDADE="3", SG_UF="SP", CO_MUN_RES="1", FEBRE="1", TOSSE="1", DISPNEIA="2", HOSPITAL="1", UTI="1", EVOLUCAO="1",
        VACINA="1", DT_INTERNA=None, DT_EVOLUCA=None,
    )
    row.update(extra)
    return tuple(row.values())


def frame(spark, *cases):
    return spark.createDataFrame(list(cases), RAW)


def test_funnel_of_the_synthetic_records(spark):
    funnel = filter_funnel(typed_cases(raw_cases(spark, "/root/testdata/sf0.01"))).orderBy("ordem").collect()
    assert [(r.entrada, r.saida) for r in funnel] == [(15300, 14688), (14688, 12846), (12846, 12076), (12076, 11843)]
    assert all(r.excluidos == r.entrada - r.saida for r in funnel) and funnel[0].perda_aceitavel


def test_funnel_agrees_with_the_filtered_table(spark):
    typed = typed_cases(raw_cases(spark, SF))
    last = filter_funnel(typed).orderBy(F.desc("ordem")).first()
    assert last.saida == apply_quality_filters(typed).count()


def test_absent_columns_are_skipped_and_reported(spark):
    raw = raw_cases(spark, SF)
    kept = select_available(raw).columns
    assert "CS_RACA" not in kept and set(kept) == set(raw.columns)
    report = column_report(raw)
    assert len(report) == len(selected_names()) == 29
    assert ("vacinacao", "DOSE_1_COV", False) in report


def test_silver_has_its_columns(spark):
    silver = silver_cases(raw_cases(spark, SF), process_id="p")
    assert {"_silver_processed_at", "_process_id", "_source_year"} <= set(silver.columns)
    # 29 selected of which 9 are absent here, 5 cleaned, 22 derived and lineage
    assert len(silver.columns) == 56 - 9
    assert not [c for c in silver.columns if c.isupper()]


def test_filters_drop_bad_dates_ages_and_repeats(spark):
    rows = frame(
        spark,
        case("1"),
        case("1", notified="05/01/2024"),
        case("2", symptom="99/99/9999"),
        case("3", symptom="03/01/2024"),
        case("4", NU_IDADE_N="121"),
        case("5", NU_IDADE_N="121", TP_IDADE="2"),
        case("6", DT_INTERNA="31/12/2023"),
        case("7", DT_INTERNA="01/01/2024", DT_EVOLUCA="31/12/2023"),
        case("8", DT_EVOLUCA="31/12/2023"),
        case(None),
    )
    silver = silver_cases(rows)
    assert sorted(r.nu_notific for r in silver.collect()) == ["1", "5", "8"]
    kept = silver.filter("nu_notific = '1'").first()
    assert kept.dt_notific == datetime.date(2024, 1, 2)
    assert silver.filter("nu_notific = '5'").first().faixa_etaria == "Desconhecido"


def test_first_per_key_does_not_depend_on_partitioning(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit(0).alias("o"), F.col("id").alias("v"))
    one = {r.k: r.v for r in first_per_key(df.repartition(1), "k", ["o"]).collect()}
    other = {r.k: r.v for r in first_per_key(df.repartition(13, "v"), "k", ["o"]).collect()}
    assert one == other and len(one) == 7


def test_icu_rate_can_pass_100_and_strict_cannot(spark):
    rows = frame(spark, case("1"), case("2", HOSPITAL="2"), case("3", HOSPITAL="2"), case("4", UTI="9"))
    silver = silver_cases(rows)
    month = gold.monthly_metrics(silver).first()
    assert month.total_internados == 2 and month.total_uti == 3 and month.taxa_uti == 150.0
    assert strict_icu_rate(rows).first().taxa_uti == 100.0


def test_rate_without_known_outcome_is_null(spark):
    silver = silver_cases(frame(spark, case("1", EVOLUCAO="9", VACINA="9", HOSPITAL="9", UTI="9")))
    month = gold.monthly_metrics(silver).first()
    assert month.taxa_mortalidade is None and month.taxa_uti is None and month.taxa_vacinacao is None
    # over all rows an unknown outcome counts as alive
    assert explore.band_mortality(silver).first().taxa_mortalidade == 0.0
    kpis = {r.metrica: r.valor for r in gold.kpi_rows(gold.national_kpis(silver)).collect()}
    assert len(kpis) == 12 and kpis["Taxa de Mortalidade (%)"] == 0.0 and kpis["Total de Casos"] == 1.0


def test_growth_steps_over_gaps_and_zero(spark):
    df = spark.createDataFrame([("2024-01", 10), ("2024-03", 0), ("2024-04", 5), ("2024-05", 10)], "m string, n int")
    out = {r.m: r.g for r in growth(df, "n", "m", "g").collect()}
    assert out == {"2024-01": None, "2024-03": -100.0, "2024-04": None, "2024-05": 100.0}


def test_unique_key_shortcut_gives_the_same_table(spark):
    silver = silver_cases(raw_cases(spark, SF))
    for table in (gold.monthly_metrics, gold.state_profile):
        exact = sorted(table(silver).collect(), key=str)
        assert exact == sorted(table(silver, key_is_unique=True).collect(), key=str)


def test_state_ties_go_by_name_and_share_counts_missing_states(spark):
    rows = frame(spark, case("1", SG_UF="SP"), case("2", SG_UF="RJ"), case("3", SG_UF=None), case("4", SG_UF=None))
    states = {r.sg_uf: (r.ranking_casos, r.percentual_nacional) for r in gold.state_profile(silver_cases(rows)).collect()}
    assert states == {"RJ": (1, 25.0), "SP": (2, 25.0)}


def test_age_sex_keeps_unknown_sex_and_shares_add_up(spark):
    profile = gold.age_sex_profile(silver_cases(raw_cases(spark, SF)))
    rows = profile.collect()
    assert {r.sexo_label for r in rows} == {"Masculino", "Feminino", "Não informado"}
    assert abs(sum(r.percentual_total for r in rows) - 100) < 0.5
    assert sum(r.total_casos for r in rows) == silver_cases(raw_cases(spark, SF)).count()


def test_daily_mean_counts_rows_or_days(spark):
    rows = frame(spark, case("1", symptom="01/01/2024", notified="20/01/2024"), case("2", symptom="01/01/2024", notified="20/01/2024"),
                 case("3", symptom="09/01/2024", notified="20/01/2024"))
    silver = silver_cases(rows)
    by_row = {r.dt_sin_pri.day: r.casos_ma7 for r in gold.daily_series(silver).collect()}
    by_day = {r.dt_sin_pri.day: r.casos_ma7 for r in gold.daily_series(silver, calendar=True).collect()}
    assert by_row == {1: 2.0, 9: 1.5}
    assert len(by_day) == 9 and by_day[9] == 0.1 and by_day[8] == 0.0


def test_series_grains_share_one_schema(spark):
    series = gold.series_table(silver_cases(raw_cases(spark, SF)))
    assert series.columns == list(gold.SERIES_SCHEMA)
    counts = {r.tipo_agregacao: (r.d, r.w) for r in series.groupBy("tipo_agregacao").agg(
        F.sum("casos_dia").alias("d"), F.sum("casos_semana").alias("w")).collect()}
    assert counts["diaria"][0] == counts["semanal"][1] and counts["diaria"][1] is None


def test_totals_agree_between_the_gold_tables(spark):
    silver = silver_cases(raw_cases(spark, SF))
    total = silver.count()
    assert gold.monthly_metrics(silver).agg(F.sum("total_casos")).first()[0] == total
    assert gold.national_kpis(silver).first().total_casos == total
    history = gold.kpi_rows(gold.national_kpis(silver)).withColumn("data_snapshot", F.current_date())
    views.create_views(history, gold.monthly_metrics(silver), gold.state_profile(silver))
    assert spark.table("vw_metricas_ultimos_6_meses").count() == 6
    assert spark.table("vw_resumo_geral_atual").count() == 12


def test_predicates(spark):
    df = spark.createDataFrame([(None,), (0,), (120,), (121,)], "a int")
    assert df.filter(range_or_null("a", 0, 120)).count() == 3
    days = spark.createDataFrame([("2024-01-01",), ("2024-03-31",), (None,)], "d string").select(F.to_date("d").alias("d"))
    assert days.filter(since_days("d", 90, "2024-03-31")).count() == 2
    assert days.filter(since_days("d", 89, "2024-03-31")).count() == 1
    bands = spark.createDataFrame([("0-17",), ("Desconhecido",), (None,)], "b string")
    assert bands.filter(known_category("b")).count() == 1


def test_equality_filters_ignore_unknown_keys_and_clean_values(spark):
    df = spark.createDataFrame([("SP", "x"), ("RJ", "x")], "uf string, secret string")
    assert equality_filters(df, {"uf": "MG", "secret": "x"}).count() == 0
    assert equality_filters(df, {"uf": " SP';", "secret": "no"}).first().uf == "SP"


def test_sample_by_key_is_repeatable(spark):
    df = spark.range(10_000)
    first = {r.id for r in sample_rows(df, 0.2, key="id").collect()}
    assert first == {r.id for r in sample_rows(df.repartition(7), 0.2, key="id").collect()}
    assert 1800 < len(first) < 2200
    assert sample_rows(df, 0.2).count() == sample_rows(df, 0.2).count()


def test_pad_to_schema(spark):
    out = pad_to_schema(spark.range(1), {"x": "string", "id": "int"})
    assert out.dtypes == [("x", "string"), ("id", "int")] and out.first().x is None


def test_typed_age_reads_the_raw_unit(spark):
    for sensitive in ("true", "false"):
        spark.conf.set("spark.sql.caseSensitive", sensitive)
        try:
            assert type_cases(frame(spark, case("1", TP_IDADE="2"), case("2"))).select("nu_idade_n").collect()[1][0] == 30
        finally:
            spark.conf.unset("spark.sql.caseSensitive")
