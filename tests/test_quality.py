"""Quality checks: thresholds, empty against missing, uniqueness of NULL keys."""

import pytest
from pyspark.sql import functions as F

from episurv.operators import explore
from episurv.operators import quality as q
from episurv.plans.cases import raw_cases
from episurv.plans.silver import silver_cases

SF = "/root/testdata/sf0.001"


def statuses(spark, bad, kind):
    df = spark.createDataFrame([(None if i < bad else "01/01/2024",) for i in range(100)], "NU_NOTIFIC string")
    if kind == "completeness":
        return q.completeness(df, ["NU_NOTIFIC"]).first().status
    broken = df.fillna("x")
    return q.date_format(broken, ["NU_NOTIFIC"]).first().status


@pytest.mark.parametrize("bad, status", [(0, "OK"), (4, "WARNING"), (5, "HIGH"), (19, "HIGH"), (20, "CRITICAL")])
def test_completeness_steps(spark, bad, status):
    assert statuses(spark, bad, "completeness") == status


@pytest.mark.parametrize("bad, status", [(0, "OK"), (4, "WARNING"), (5, "CRITICAL")])
def test_date_format_steps(spark, bad, status):
    assert statuses(spark, bad, "date_format") == status


def test_empty_is_missing_for_completeness_and_invalid_for_domain(spark):
    df = spark.createDataFrame([("",), (None,), (" ",), ("1",)], "UTI string")
    complete, domain = q.completeness(df, ["UTI"]).first(), q.domain(df, {"UTI": ["1", "2", "9"]}).first()
    assert (complete.total, complete.null_count, complete.null_pct) == (4, 2, 50.0)
    assert (domain.total, domain.invalid_count, domain.status) == (3, 2, "CRITICAL")
    assert domain.valid_values == "['1', '2', '9']"
    dates = q.date_format(df, ["UTI"]).first()
    assert (dates.total, dates.invalid_count) == (3, 3)


def test_null_is_one_distinct_value(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",), ("b",)], "k string")
    check = q.uniqueness(df, "k").first()
    assert (check["distinct"], check.duplicate_count, check.duplicate_pct, check.status) == (3, 1, 25.0, "CRITICAL")
    assert q.uniqueness(df.dropna().distinct(), "k").first().status == "OK"


def test_empty_table_has_no_failures(spark):
    df = spark.createDataFrame([], "UTI string")
    assert q.completeness(df, ["UTI"]).first().status == "OK"
    assert q.uniqueness(df, "UTI").first().duplicate_count == 0


def test_date_order_tolerates_below_one_percent(spark):
    def check(bad):
        rows = [("02/01/2024" if i < bad else "01/01/2024", "2024-01-01") for i in range(1000)]
        return q.date_order(spark.createDataFrame(rows, "a string, b string"), [("a", "b")]).first()

    assert check(9).status == "OK" and check(9).inconsistent_pct == 0.9
    assert check(10).status == "CRITICAL"


def test_all_checks_have_one_schema_and_every_kind(spark):
    checks = q.all_checks(raw_cases(spark, SF))
    rows = checks.collect()
    assert set(checks.columns) == set(q.CHECK_SCHEMA)
    kinds = {k: sum(r.check_type == k for r in rows) for k in {r.check_type for r in rows}}
    assert kinds == {"completeness": 18, "domain": 8, "date_format": 5, "consistency": 4, "uniqueness": 1}
    summary = q.executive_summary(checks, explore.ignored_codes(raw_cases(spark, SF))).first()
    assert summary.total_checks == 36 == summary.checks_ok + summary.checks_warning + summary.checks_high + summary.checks_critical


def test_fused_checks_read_the_input_once(spark):
    raw = raw_cases(spark, SF)
    plan = q.fused_checks(q.with_dates(raw), q.completeness_entries(raw), q.domain_entries(raw), q.date_format_entries(raw))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 3  # orders, customer, nation


def test_ignored_code_severity(spark):
    rows = [("9" if i < 21 else "1", "9" if i < 20 else "1", "9" if i < 10 else "1") for i in range(100)]
    out = {r.field: r.severity for r in explore.ignored_codes(spark.createDataFrame(rows, "UTI string, FEBRE string, TOSSE string")).collect()}
    assert out == {"UTI": "HIGH", "FEBRE": "MEDIUM", "TOSSE": "LOW"}


def test_gates_report_and_raise(spark):
    raw = raw_cases(spark, SF)
    silver = silver_cases(raw)
    report = q.load_gates(raw, silver)
    assert report.filter("not ok").count() == 0
    q.require_gates(report)
    doubled = silver.unionByName(silver).withColumn("ano", F.lit(None).cast("int"))
    with pytest.raises(ValueError, match="chaves_repetidas, nulos_ano"):
        q.require_gates(q.load_gates(raw, doubled))


def test_score_counts_absent_fields(spark):
    df = spark.createDataFrame([("1", "a")], "UTI string, SG_UF string")
    score = q.quality_score(q.completeness(df)).first()
    assert (score.campos_ok, score.quality_score) == (2, 10.0)
