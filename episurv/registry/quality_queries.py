"""Quality checks and the audit queries over their log."""

from __future__ import annotations

from pyspark.sql import functions as F

from episurv.functions.codes import CRITICAL_FIELDS, DATE_COLUMNS, DATE_ORDER_PAIRS, VALID_VALUES
from episurv.operators import explore as ex
from episurv.operators import quality as q
from episurv.plans.cases import raw_cases, table
from episurv.plans.silver import written_silver
from episurv.session import scratch_path
from episurv.registry import query
from episurv.registry.explore_queries import _CODE9
from episurv.registry.sql import RAW, SILVER, _date, n_if

_ABSENT = {"SATURACAO", "VACINA_COV"}


def _check(kind: str, field: str, total: str, bad: str, valid="NULL", formats="NULL", relation="NULL") -> str:
    return (
        f"SELECT '{kind}' AS check_type, '{field}' AS field, {total} AS total, {bad} AS bad, CAST(NULL AS BIGINT) AS dist, "
        f"CAST({valid} AS VARCHAR) AS valid_values, CAST({formats} AS VARCHAR) AS accepted_formats, "
        f"CAST({relation} AS VARCHAR) AS relationship FROM raw"
    )


def _list(values) -> str:
    return "'" + str(list(values)).replace("'", "''") + "'"


COMPLETE = [
    _check("completeness", f, "count(*)", n_if(f"{f} IS NULL OR {f} = ''"))
    for fields in CRITICAL_FIELDS.values() for f in fields if f not in _ABSENT
]
DOMAIN = [
    _check("domain", f, f"count({f})", n_if(f"{f} NOT IN ({', '.join(repr(v) for v in vs)})"), valid=_list(vs))
    for f, vs in VALID_VALUES.items() if f not in _ABSENT
]
FORMAT = [
    _check("date_format", f, f"count({f})", n_if(f"{f} IS NOT NULL AND {_date(f)} IS NULL"), formats="'dd/MM/yyyy | yyyy-MM-dd'")
    for f in DATE_COLUMNS
]
ORDER = [
    _check("consistency", f"{a} vs {b}", n_if(f"{_date(a)} IS NOT NULL AND {_date(b)} IS NOT NULL"), n_if(f"{_date(a)} > {_date(b)}"), relation="'before'")
    for a, b in DATE_ORDER_PAIRS
]
UNIQUE = [
    """SELECT 'uniqueness', 'NU_NOTIFIC', count(*), count(*) - count(DISTINCT NU_NOTIFIC) - max((NU_NOTIFIC IS NULL)::INT),
    count(DISTINCT NU_NOTIFIC) + max((NU_NOTIFIC IS NULL)::INT), NULL, NULL, NULL FROM raw"""
]


def _share(x: str) -> str:
    return f"(coalesce({x}::DOUBLE / nullif(total, 0), 0) * 100)"


def checks_cte(parts: list[str]) -> str:
    s = _share("bad")
    cols = []
    for prefix, kinds in {
        "null": "('completeness')", "invalid": "('domain', 'date_format')",
        "inconsistent": "('consistency')", "duplicate": "('uniqueness')",
    }.items():
        cols.append(f"CASE WHEN check_type IN {kinds} THEN bad END AS {prefix}_count")
        cols.append(f"CASE WHEN check_type IN {kinds} THEN round({s}, 2) END AS {prefix}_pct")
    return f"""counts AS ({' UNION ALL '.join(parts)}),
    checks AS (SELECT field, check_type, total, {', '.join(cols)}, dist AS "distinct", valid_values, accepted_formats, relationship,
      CASE WHEN check_type = 'completeness' THEN CASE WHEN {s} = 0 THEN 'OK' WHEN {s} < 5 THEN 'WARNING' WHEN {s} < 20 THEN 'HIGH' ELSE 'CRITICAL' END
        WHEN check_type = 'date_format' THEN CASE WHEN {s} = 0 THEN 'OK' WHEN {s} < 5 THEN 'WARNING' ELSE 'CRITICAL' END
        WHEN check_type = 'consistency' THEN CASE WHEN {s} < 1 THEN 'OK' ELSE 'CRITICAL' END
        ELSE CASE WHEN {s} = 0 THEN 'OK' ELSE 'CRITICAL' END END AS status
      FROM counts)"""


ALL = checks_cte(COMPLETE + DOMAIN + FORMAT + ORDER + UNIQUE)
ONLY_COMPLETE = checks_cte(COMPLETE)


@query("q1_completeness", f"{RAW}, {ONLY_COMPLETE} SELECT field, check_type, total, null_count, null_pct, status FROM checks")
def q1(spark, d):
    return q.completeness(raw_cases(spark, d))


@query("q2_domain", f"{RAW}, {checks_cte(DOMAIN)} SELECT field, check_type, total, invalid_count, invalid_pct, valid_values, status FROM checks")
def q2(spark, d):
    return q.domain(raw_cases(spark, d))


@query("q3_date_format", f"{RAW}, {checks_cte(FORMAT)} SELECT field, check_type, total, invalid_count, invalid_pct, accepted_formats, status FROM checks")
def q3(spark, d):
    return q.date_format(raw_cases(spark, d))


@query(
    "q4_uniqueness",
    f"""{RAW}, {checks_cte([COMPLETE[0]] + UNIQUE)} SELECT field, check_type, total, "distinct", duplicate_count, duplicate_pct, status
    FROM checks WHERE check_type = 'uniqueness'""",
)
def q4(spark, d):
    return q.uniqueness(raw_cases(spark, d), "NU_NOTIFIC")


@query("q5_date_order", f"{RAW}, {checks_cte(ORDER)} SELECT field, check_type, total, inconsistent_count, inconsistent_pct, relationship, status FROM checks")
def q5(spark, d):
    return q.date_order(raw_cases(spark, d))


@query(
    "q6_null_share_by_year",
    f"""{RAW} SELECT ANO_DADOS, count(*) AS total_registros, {', '.join(
        f'''round({n_if(f"{c} IS NULL OR {c} = ''")}::DOUBLE / count(*) * 100, 2) AS {c}_null_pct'''
        for c in ('DT_SIN_PRI', 'EVOLUCAO', 'UTI', 'VACINA'))} FROM raw GROUP BY ANO_DADOS""",
)
def q6(spark, d):
    return q.null_share_by_year(raw_cases(spark, d))


_VALUES = " UNION ALL ".join(
    f"SELECT '{f}' AS field, {f} AS valor, count(*) AS casos FROM raw GROUP BY {f}" for f in VALID_VALUES if f not in _ABSENT
)


@query(
    "q7_actual_values",
    f"""{RAW}, {checks_cte(DOMAIN)}, found AS ({_VALUES}) SELECT field, valor, casos FROM found
    WHERE field IN (SELECT field FROM checks WHERE status = 'CRITICAL')
    QUALIFY row_number() OVER (PARTITION BY field ORDER BY casos DESC, valor) <= 20""",
)
def q7(spark, d):
    raw = raw_cases(spark, d)
    return q.actual_values(raw, q.domain(raw))


CHECK_COLS = ", ".join(f'"{c}"' for c in q.CHECK_SCHEMA)


@query("q8_check_log", f"{RAW}, {ALL} SELECT {CHECK_COLS}, 'run-1' AS validation_id, '2024-01-01 00:00:00.000000' AS timestamp FROM checks")
def q8(spark, d):
    return q.check_log(q.all_checks(raw_cases(spark, d)), "run-1", "2024-01-01 00:00:00")


_STATUS_COUNTS = ", ".join(f"{n_if(f'''status = '{s}' ''')} AS checks_{s.lower()}" for s in ("OK", "WARNING", "HIGH", "CRITICAL"))
_CODE9_HIGH = " + ".join(f"(SELECT ({n_if(f'''{c} = '9' ''')}::DOUBLE / count(*) * 100 > 20)::INT FROM raw)" for c in _CODE9)


@query(
    "q9_executive_summary",
    f"""{RAW}, {ALL} SELECT count(*) AS total_checks, {_STATUS_COUNTS}, {n_if("check_type = 'completeness'")} AS critical_fields_analyzed,
    {n_if("check_type = 'completeness' AND null_pct > 20")} AS fields_with_high_missing,
    CAST({_CODE9_HIGH} AS BIGINT) AS fields_with_high_code9 FROM checks""",
)
def q9(spark, d):
    raw = raw_cases(spark, d)
    return q.executive_summary(q.all_checks(raw), ex.ignored_codes(raw))


@query(
    "q10_quality_score",
    f"""{RAW}, {ONLY_COMPLETE} SELECT 20 AS campos_criticos, {n_if("status = 'OK'")} AS campos_ok,
    {n_if("status IN ('WARNING', 'HIGH')")} AS campos_warning, {n_if("status = 'CRITICAL'")} AS campos_critical,
    round({n_if("status = 'OK'")} * 100.0::DOUBLE / 20, 1) AS quality_score FROM checks""",
)
def q10(spark, d):
    return q.quality_score(q.completeness(raw_cases(spark, d)))


def _two_runs(spark, d):
    """The log of two runs: all records, and the records of the later years."""
    source, target = scratch_path(spark, "raw"), scratch_path(spark, "check-log")
    raw_cases(spark, d).write.parquet(source)
    raw = spark.read.parquet(source)
    runs = [(raw, "run-1", "2024-01-01 00:00:00"), (raw.filter(F.col("ANO_DADOS") >= 1999), "run-2", "2024-02-01 00:00:00")]
    for rows, run, at in runs:
        log = q.check_log(q.all_checks(rows), run, at)
        log.write.mode("append").parquet(target)
    return spark.read.schema(log.schema).parquet(target)


_LATER = ALL.replace("counts AS", "counts2 AS").replace("checks AS", "checks2 AS").replace("FROM counts)", "FROM counts2)").replace("FROM raw", "FROM later")
TWO_RUNS = f"""{RAW}, later AS (SELECT * FROM raw WHERE ANO_DADOS >= 1999), {ALL}, {_LATER},
  log AS (SELECT *, 'run-1' AS validation_id, TIMESTAMP '2024-01-01' AS timestamp FROM checks
    UNION ALL SELECT *, 'run-2', TIMESTAMP '2024-02-01' FROM checks2)"""


@query("q11_checks_by_severity", f"{TWO_RUNS} SELECT check_type, field, status, null_pct, invalid_pct, inconsistent_pct FROM log WHERE validation_id = 'run-1'")
def q11_severity(spark, d):
    return q.checks_by_severity(_two_runs(spark, d), "run-1")


@query("q11_critical_checks", f"{TWO_RUNS} SELECT field, check_type, null_pct, invalid_pct, status FROM log WHERE validation_id = 'run-2' AND status = 'CRITICAL'")
def q11_critical(spark, d):
    return q.critical_checks(_two_runs(spark, d), "run-2")


@query(
    "q11_score_history",
    f"""{TWO_RUNS} SELECT validation_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS data_validacao, {n_if("status = 'OK'")} AS checks_ok,
    {n_if("status = 'CRITICAL'")} AS checks_critical, round({n_if("status = 'OK'")} * 100.0::DOUBLE / count(*), 2) AS quality_score_pct
    FROM log GROUP BY validation_id, timestamp""",
)
def q11_history(spark, d):
    return q.score_history(_two_runs(spark, d))


@query(
    "q11_key_field_checks",
    f"{TWO_RUNS} SELECT field, check_type, null_pct, status FROM log WHERE validation_id = 'run-1' AND field IN ('DT_SIN_PRI', 'EVOLUCAO', 'UTI', 'HOSPITAL', 'SG_UF')",
)
def q11_key(spark, d):
    return q.key_field_checks(_two_runs(spark, d), "run-1")


@query(
    "j1_critical_field_history",
    f"""{TWO_RUNS} SELECT field, validation_id, null_pct, status, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp FROM log
    WHERE field IN (SELECT DISTINCT field FROM log WHERE status = 'CRITICAL')""",
)
def j1(spark, d):
    return q.critical_field_history(_two_runs(spark, d))


@query(
    "j1_semi_join_events",
    "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 60)",
)
def j1_events(spark, d):
    events = table(spark, d, "events")
    bad = events.filter((F.col("event_type") == "error") & (F.col("value") > 60)).select("user_id")
    return events.join(bad, "user_id", "left_semi").select("event_id", "user_id", "event_type")


_ACTION_SQL = "CASE " + " ".join(
    "WHEN field IN ({}) THEN '{}'".format(", ".join(f"'{f}'" for f in fields), text.replace("'", "''"))
    for fields, text in q.ACTIONS
) + f" ELSE '{q.DEFAULT_ACTION}' END"


@query("q12_suggested_actions", f"{RAW}, {ONLY_COMPLETE} SELECT field, null_pct, status, {_ACTION_SQL} AS acao FROM checks WHERE status IN ('CRITICAL', 'HIGH')")
def q12(spark, d):
    return q.suggested_actions(q.completeness(raw_cases(spark, d)))


_REQUIRED = ("nu_notific", "dt_sin_pri", "dt_notific", "ano", "mes")


@query(
    "q13_load_gates",
    f"""{SILVER}, l AS (SELECT round((1 - (SELECT count(*) FROM silver)::DOUBLE / (SELECT count(*) FROM raw)) * 100, 2) AS v)
    SELECT 'perda_pct' AS verificacao, v AS valor, v < 60 AS ok FROM l
    UNION ALL SELECT 'chaves_repetidas', (count(*) - count(DISTINCT nu_notific))::DOUBLE, count(*) = count(DISTINCT nu_notific) FROM silver
    {' '.join(f"UNION ALL SELECT 'nulos_{c}', ({n_if(f'{c} IS NULL')})::DOUBLE, ({n_if(f'{c} IS NULL')}) = 0 FROM silver" for c in _REQUIRED)}
    UNION ALL SELECT 'datas_invertidas', ({n_if('dt_sin_pri > dt_notific')})::DOUBLE, ({n_if('dt_sin_pri > dt_notific')}) = 0 FROM silver
    UNION ALL SELECT 'particoes', count(*)::DOUBLE, count(*) > 0 FROM (SELECT DISTINCT ano, mes FROM silver)""",
)
def q13(spark, d):
    return q.load_gates(raw_cases(spark, d), written_silver(spark, d))


@query("q14_status_distribution", f"{RAW}, {ALL} SELECT status, count(*) AS checks FROM checks GROUP BY status")
def q14(spark, d):
    return q.status_distribution(q.all_checks(raw_cases(spark, d)))
