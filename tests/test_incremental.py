"""Merged partial states next to the full rebuild."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from episurv.plans import gold, incremental
from episurv.plans.silver import silver_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def silver(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("silver") / "table")
    silver_of(spark, SF).coalesce(2).write.partitionBy("ano", "mes").parquet(path)
    return path


def files_read(df):
    """What the scan of a query opens, as its own metric counts it."""
    df = df.select("nu_notific")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while "FileSourceScanExec" not in plan.getClass().getSimpleName():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numFiles").value()


def rows(df):
    return sorted((tuple(sorted(r.asDict().items(), key=lambda kv: kv[0])) for r in df.collect()), key=str)


def test_a_changed_month_is_all_that_is_read_and_written(spark, silver, scratch):
    table, folder = spark.read.parquet(silver), f"{scratch}/gold"
    stale = table.filter("NOT (ano = 1997 AND mes = 3 AND nu_idade_n > 40)")  # a load that missed some cases
    incremental.update_months(stale, folder)
    assert rows(incremental.monthly_table(spark, folder)) == rows(gold.monthly_metrics(stale))
    month = incremental.read_months(spark, silver, [(1997, 3)])
    assert files_read(month) == len(list(Path(silver, "ano=1997", "mes=3").glob("*.parquet"))) < files_read(table)

    def others():
        return {f: f.stat().st_mtime_ns for f in Path(folder).rglob("*.parquet") if "/ano=1997/mes=3/" not in str(f)}

    before = others()
    incremental.update_months(month, folder, [(1997, 3)])
    assert others() == before
    assert rows(incremental.monthly_table(spark, folder)) == rows(gold.monthly_metrics(table))
    assert rows(incremental.national_table(spark, folder)) == rows(gold.national_kpis(table))


def test_distinct_cases_merge_over_months(spark, scratch):
    base = "CAST({0} AS STRING) nu_notific, {1} ano, {2} mes, '{1}-0{2}' ano_mes"
    silver = spark.range(1).selectExpr("id")
    parts = [(1, 2020, 1), (70_000, 2020, 1), (1, 2020, 2), (2, 2020, 2), (70_000, 2020, 3)]
    ids = None
    for n, y, m in parts:
        row = silver.selectExpr(*base.format(n, y, m).split(", "))
        ids = row if ids is None else ids.union(row)
    for c in ("evolucao_clean", "vacina_clean", "sg_uf"):
        ids = ids.withColumn(c, F.lit("1"))
    for c in ("is_internado", "is_uti", "is_vacinado", "has_febre", "has_tosse", "has_dispneia", "is_idoso"):
        ids = ids.withColumn(c, F.lit(True))
    for c in ("nu_idade_n", "tempo_sintoma_notificacao", "tempo_sintoma_internacao", "tempo_internacao"):
        ids = ids.withColumn(c, F.lit(5))
    folder = f"{scratch}/gold"
    incremental.update_months(ids, folder)

    def span(a, b):
        return incremental.distinct_cases(spark, folder, a, b).first()[0]

    assert [span("2020-01", "2020-01"), span("2020-01", "2020-02"), span("2020-01", "2020-03"), span("2021-01", "2021-02")] == [2, 3, 3, 0]
    incremental.update_months(ids.filter("mes = 9"), folder, [(2020, 1)])  # the month is empty now
    assert span("2020-01", "2020-03") == 3 and span("2020-01", "2020-01") == 0
    assert {r.ano_mes for r in incremental.monthly_table(spark, folder).collect()} == {"2020-02", "2020-03"}
    with pytest.raises(Exception, match="not a number"):
        incremental.update_months(ids.withColumn("nu_notific", F.lit("A1")), f"{scratch}/refused")
