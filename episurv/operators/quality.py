"""Data-quality checks: one aggregate per kind of work, one result row per check."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from episurv.functions.codes import (
    CRITICAL_FIELDS,
    DATE_COLUMNS,
    DATE_FORMATS,
    DATE_ORDER_PAIRS,
    MAX_LOAD_LOSS_PCT,
    VALID_VALUES,
    YEARLY_NULL_FIELDS,
)
from episurv.functions.columns import is_missing, ordinal, parse_date_multi, pct
from episurv.functions.reshape import measures_to_rows, with_values
from episurv.operators.rates import rows

# Severity order and the key fields of the audit queries.
STATUS_ORDER = ["CRITICAL", "HIGH", "WARNING"]
KEY_FIELDS = ["DT_SIN_PRI", "EVOLUCAO", "UTI", "HOSPITAL", "SG_UF"]
HIGH_SHARE_PCT = 20

# Every check, whatever its kind, is logged in these columns.
CHECK_SCHEMA = {
    "field": "string",
    "check_type": "string",
    "total": "bigint",
    "null_count": "bigint",
    "null_pct": "double",
    "invalid_count": "bigint",
    "invalid_pct": "double",
    "inconsistent_count": "bigint",
    "inconsistent_pct": "double",
    "distinct": "bigint",
    "duplicate_count": "bigint",
    "duplicate_pct": "double",
    "valid_values": "string",
    "accepted_formats": "string",
    "relationship": "string",
    "status": "string",
}


def critical_fields(groups: Mapping[str, Sequence[str]] = CRITICAL_FIELDS) -> list[str]:
    return [f for fields in groups.values() for f in fields]


def _exact_pct(bad: str) -> Column:
    return F.coalesce(F.try_divide(F.col(bad).cast("double"), F.col("total").cast("double")) * 100.0, F.lit(0.0))


def _status(bad: str, kind: str) -> Column:
    share = _exact_pct(bad)
    if kind == "completeness":
        return (
            F.when(share == 0, "OK").when(share < 5, "WARNING").when(share < 20, "HIGH").otherwise("CRITICAL")
        )
    if kind == "date_format":
        return F.when(share == 0, "OK").when(share < 5, "WARNING").otherwise("CRITICAL")
    if kind == "consistency":
        return F.when(share < 1, "OK").otherwise("CRITICAL")
    return F.when(share == 0, "OK").otherwise("CRITICAL")


def _entry(kind: str, field: str, total: Column, bad: Column, **texts: str):
    constants = {"field": field, "check_type": kind}
    for name in ("valid_values", "accepted_formats", "relationship"):
        constants[name] = texts.get(name, "")
    return constants, {"total": total, "_bad": bad}


def completeness_entries(df: DataFrame, fields: Sequence[str] | None = None):
    """NULL or empty, over all rows."""
    fields = critical_fields() if fields is None else fields
    return [
        _entry("completeness", f, rows(), F.count_if(is_missing(f))) for f in fields if f in df.columns
    ]


def domain_entries(df: DataFrame, values: Mapping[str, Sequence[str]] = VALID_VALUES):
    """Outside the listed values, over rows that are not NULL; the empty string is invalid."""
    return [
        _entry("domain", f, F.count(F.col(f)), F.count_if(~F.col(f).isin(*valid)), valid_values=str(list(valid)))
        for f, valid in values.items()
        if f in df.columns
    ]


def _date(field: str) -> str:
    return f"_date_{field}"


def with_dates(df: DataFrame, fields: Sequence[str] = DATE_COLUMNS, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Parsed dates beside their texts, once per row for all date checks."""
    return with_values(df, {_date(f): parse_date_multi(f, formats) for f in fields if f in df.columns})


def date_format_entries(df: DataFrame, fields: Sequence[str] = DATE_COLUMNS, formats: Sequence[str] = DATE_FORMATS):
    """Parsable in no accepted format, over rows that are not NULL. Reads the columns of `with_dates`."""
    return [
        _entry(
            "date_format", f, F.count(F.col(f)),
            F.count_if(F.col(f).isNotNull() & F.col(_date(f)).isNull()),
            accepted_formats=" | ".join(formats),
        )
        for f in fields
        if f in df.columns
    ]


def date_order_entries(df: DataFrame, pairs: Sequence[tuple[str, str]] = DATE_ORDER_PAIRS):
    """First date after the second, over rows where both parse. Reads the columns of `with_dates`."""
    entries = []
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            x, y = F.col(_date(a)), F.col(_date(b))
            entries.append(
                _entry(
                    "consistency", f"{a} vs {b}", F.count_if(x.isNotNull() & y.isNotNull()), F.count_if(x > y),
                    relationship="before",
                )
            )
    return entries


_COUNT_COLUMN = {
    "completeness": "null",
    "domain": "invalid",
    "date_format": "invalid",
    "consistency": "inconsistent",
    "uniqueness": "duplicate",
}


def _finish(measured: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Counts, percentages and status in the columns of each kind of check."""
    status = F.lit(None).cast("string")
    values: dict[str, Column] = {}
    for kind in kinds:
        mine = F.col("check_type") == kind
        prefix = _COUNT_COLUMN[kind]
        status = F.when(mine, _status("_bad", kind)).otherwise(status)
        for name, value in ((f"{prefix}_count", F.col("_bad")), (f"{prefix}_pct", pct(F.col("_bad"), F.col("total")))):
            values[name] = F.when(mine, value).otherwise(values.get(name, F.lit(None)))
    texts = {
        n: F.when(F.col(n) != "", F.col(n))
        for n in ("valid_values", "accepted_formats", "relationship")
        if n in measured.columns
    }
    out = measured.withColumns({**values, **texts, "status": status}).drop("_bad")
    return out.select(*[F.col(n).cast(t).alias(n) for n, t in CHECK_SCHEMA.items() if n in out.columns])


def fused_checks(df: DataFrame, *entry_lists) -> DataFrame:
    """All conditional counts of all checks in one pass over the input."""
    entries = [e for entries in entry_lists for e in entries]
    return _finish(measures_to_rows(df, entries), sorted({constants["check_type"] for constants, _ in entries}))


def completeness(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    return fused_checks(df, completeness_entries(df, fields)).drop("valid_values", "accepted_formats", "relationship")


def domain(df: DataFrame, values: Mapping[str, Sequence[str]] = VALID_VALUES) -> DataFrame:
    return fused_checks(df, domain_entries(df, values)).drop("accepted_formats", "relationship")


def date_format(df: DataFrame, fields: Sequence[str] = DATE_COLUMNS) -> DataFrame:
    return fused_checks(with_dates(df, fields), date_format_entries(df, fields)).drop("valid_values", "relationship")


def date_order(df: DataFrame, pairs: Sequence[tuple[str, str]] = DATE_ORDER_PAIRS) -> DataFrame:
    fields = list(dict.fromkeys(f for pair in pairs for f in pair))
    return fused_checks(with_dates(df, fields), date_order_entries(df, pairs)).drop("valid_values", "accepted_formats")


def distinct_values(c: str) -> Column:
    """Number of distinct values with NULL as one of them."""
    return F.count_distinct(F.col(c)) + F.coalesce(F.max(F.col(c).isNull().cast("bigint")), F.lit(0))


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key.

    Kept apart from the fused checks: a distinct count must move the keys, and sharing an
    aggregate would move every other counter along with each key. Here only the key is read.
    """
    measured = df.select(key).agg(rows().alias("total"), distinct_values(key).alias("distinct"))
    return _finish(
        measured.withColumns(
            {
                "field": F.lit(key),
                "check_type": F.lit("uniqueness"),
                "_bad": F.col("total") - F.col("distinct"),
            }
        ),
        ["uniqueness"],
    )


def all_checks(df: DataFrame, key: str = "NU_NOTIFIC") -> DataFrame:
    """Every check as one table: two passes over the input in all."""
    fused = fused_checks(
        with_dates(df), completeness_entries(df), domain_entries(df), date_format_entries(df), date_order_entries(df)
    )
    return fused.unionByName(uniqueness(df, key), allowMissingColumns=True)


def check_log(checks: DataFrame, validation_id: str, at: str | None = None) -> DataFrame:
    """Checks with the run they belong to, ready to be appended."""
    time = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return checks.withColumns({"validation_id": F.lit(validation_id), "timestamp": time})


def null_share_by_year(
    df: DataFrame, fields: Sequence[str] = YEARLY_NULL_FIELDS, year: str = "ANO_DADOS"
) -> DataFrame:
    return (
        df.groupBy(year)
        .agg(
            rows().alias("total_registros"),
            *[pct(F.count_if(is_missing(f)), rows()).alias(f"{f}_null_pct") for f in fields],
        )
        .orderBy(year)
    )


def actual_values(df: DataFrame, checks: DataFrame, values: Mapping[str, Sequence[str]] = VALID_VALUES, n: int = 20) -> DataFrame:
    """Values found in the fields whose domain check failed, at most n per field.

    All fields are counted in one pass; the failed ones are picked by joining the few check rows.
    """
    present = [f for f in values if f in df.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("valor")) for f in present])
    counts = df.select(F.inline(pairs)).groupBy("field", "valor").agg(rows().alias("casos"))
    failed = checks.filter((F.col("check_type") == "domain") & (F.col("status") == "CRITICAL")).select("field")
    w = Window.partitionBy("field").orderBy(F.desc("casos"), F.col("valor").asc_nulls_last())
    return (
        counts.join(failed, "field", "left_semi")
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= n)
        .drop("_rn")
    )


def executive_summary(checks: DataFrame, ignored: DataFrame) -> DataFrame:
    """Checks by status and the number of fields with a high missing or ignored share."""
    per_status = [
        F.count_if(F.col("status") == s).alias(f"checks_{s.lower()}") for s in ("OK", "WARNING", "HIGH", "CRITICAL")
    ]
    complete = F.col("check_type") == "completeness"
    head = checks.agg(
        F.count(F.lit(1)).alias("total_checks"),
        *per_status,
        F.count_if(complete).alias("critical_fields_analyzed"),
        F.count_if(complete & (F.col("null_pct") > HIGH_SHARE_PCT)).alias("fields_with_high_missing"),
    ).withColumn("_one", F.lit(True))
    tail = ignored.agg(F.count_if(F.col("code9_pct") > HIGH_SHARE_PCT).alias("fields_with_high_code9"))
    return head.join(tail.withColumn("_one", F.lit(True)), "_one").drop("_one")


def quality_score(checks: DataFrame, n_fields: int | None = None) -> DataFrame:
    """Complete fields over all critical fields, absent ones included."""
    n = len(critical_fields()) if n_fields is None else n_fields
    ok = F.count_if(F.col("status") == "OK")
    return checks.filter(F.col("check_type") == "completeness").agg(
        F.lit(n).alias("campos_criticos"),
        ok.alias("campos_ok"),
        F.count_if(F.col("status").isin("WARNING", "HIGH")).alias("campos_warning"),
        F.count_if(F.col("status") == "CRITICAL").alias("campos_critical"),
        F.round(ok * 100.0 / F.lit(float(n)), 1).alias("quality_score"),
    )


# --- audit queries over the check log -------------------------------------------------------


def _of_run(log: DataFrame, validation_id: str) -> DataFrame:
    return log.filter(F.col("validation_id") == validation_id)


def checks_by_severity(log: DataFrame, validation_id: str) -> DataFrame:
    return (
        _of_run(log, validation_id)
        .select("check_type", "field", "status", "null_pct", "invalid_pct", "inconsistent_pct")
        .orderBy(ordinal("status", STATUS_ORDER, 4), F.desc("null_pct"), "check_type", "field")
    )


def critical_checks(log: DataFrame, validation_id: str) -> DataFrame:
    return (
        _of_run(log, validation_id)
        .filter(F.col("status") == "CRITICAL")
        .select("field", "check_type", "null_pct", "invalid_pct", "status")
        .orderBy(F.desc("null_pct"), "field")
    )


def key_field_checks(log: DataFrame, validation_id: str, fields: Sequence[str] = KEY_FIELDS) -> DataFrame:
    return (
        _of_run(log, validation_id)
        .filter(F.col("field").isin(*fields))
        .select("field", "check_type", "null_pct", "status")
        .orderBy(F.desc("null_pct"), "field", "check_type")
    )


def score_history(log: DataFrame, n: int = 10) -> DataFrame:
    """Share of passed checks of the last runs."""
    ok = F.count_if(F.col("status") == "OK")
    return (
        log.groupBy("validation_id", F.to_date("timestamp").alias("data_validacao"))
        .agg(
            F.max("timestamp").alias("_at"),
            ok.alias("checks_ok"),
            F.count_if(F.col("status") == "CRITICAL").alias("checks_critical"),
            F.round(ok * 100.0 / rows(), 2).alias("quality_score_pct"),
        )
        .orderBy(F.desc("_at"), "validation_id")
        .limit(n)
        .drop("_at")
    )


def critical_field_history(log: DataFrame) -> DataFrame:
    """All checks of the fields that were ever critical."""
    critical = log.filter(F.col("status") == "CRITICAL").select("field")
    return log.join(critical, "field", "left_semi").select("field", "validation_id", "null_pct", "status", "timestamp")


def status_distribution(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(rows().alias("checks")).orderBy("status")


# Suggested action per field, first match.
ACTIONS = [
    (["DT_SIN_PRI", "DT_NOTIFIC"], "EXCLUIR registros sem esta data (campo essencial)"),
    (["EVOLUCAO"], "MANTER apenas registros com EVOLUCAO ∈ {1,2} para métricas"),
    (["FEBRE", "TOSSE", "DISPNEIA"], "CONSIDERAR '9' como categoria válida, NÃO imputar"),
    (["VACINA", "VACINA_COV"], "ACEITAR missing (nem sempre disponível)"),
]
DEFAULT_ACTION = "AVALIAR caso a caso na camada Silver"


def suggested_actions(checks: DataFrame, statuses: Sequence[str] = ("CRITICAL", "HIGH")) -> DataFrame:
    action = F.lit(DEFAULT_ACTION)
    for fields, text in reversed(ACTIONS):
        action = F.when(F.col("field").isin(*fields), F.lit(text)).otherwise(action)
    return checks.filter((F.col("check_type") == "completeness") & F.col("status").isin(*statuses)).select(
        "field", "null_pct", "status", action.alias("acao")
    )


# --- gates ----------------------------------------------------------------------------------


def load_gates(
    raw: DataFrame,
    silver: DataFrame,
    key: str = "nu_notific",
    required: Sequence[str] = ("nu_notific", "dt_sin_pri", "dt_notific", "ano", "mes"),
    max_loss_pct: float = MAX_LOAD_LOSS_PCT,
    partitions: Sequence[str] = ("ano", "mes"),
) -> DataFrame:
    """One report row per gate: loss, unique key, required columns, date order, number of partitions."""
    before = raw.agg(rows().alias("_raw")).withColumn("_one", F.lit(True))
    after = silver.agg(*_gate_counts(required)).withColumn("_one", F.lit(True))
    joined = after.join(before, "_one").join(_distinct_parts(silver, key, partitions), "_one")
    return _gates(joined, required, max_loss_pct)


def _gate_counts(required: Sequence[str]) -> list[Column]:
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in required]
    return [rows().alias("_rows"), *nulls, F.count_if(F.col("dt_sin_pri") > F.col("dt_notific")).alias("_inverted")]


def _distinct_parts(silver: DataFrame, key: str, partitions: Sequence[str]) -> DataFrame:
    distinct = silver.select(key).agg(distinct_values(key).alias("_keys")).withColumn("_one", F.lit(True))
    parts = silver.select(*partitions).distinct().agg(rows().alias("_parts")).withColumn("_one", F.lit(True))
    return distinct.join(parts, "_one")


def _gates(counts: DataFrame, required: Sequence[str], max_loss_pct: float) -> DataFrame:
    loss = F.round((F.lit(1.0) - F.try_divide(F.col("_rows").cast("double"), F.col("_raw").cast("double"))) * 100.0, 2)

    def gate(name: str, value: Column, ok: Column):
        return F.struct(
            F.lit(name).alias("verificacao"), value.cast("double").alias("valor"), F.coalesce(ok, F.lit(False)).alias("ok")
        )

    gates = [
        gate("perda_pct", loss, loss < max_loss_pct),
        gate("chaves_repetidas", F.col("_rows") - F.col("_keys"), F.col("_rows") == F.col("_keys")),
        *[gate(f"nulos_{c}", F.col(f"_null_{c}"), F.col(f"_null_{c}") == 0) for c in required],
        gate("datas_invertidas", F.col("_inverted"), F.col("_inverted") == 0),
        gate("particoes", F.col("_parts"), F.col("_parts") > 0),
    ]
    return counts.select(F.inline(F.array(*gates)))


def write_through_gates(
    raw: DataFrame,
    to_silver: Callable[[DataFrame], DataFrame],
    target: str,
    key: str = "nu_notific",
    required: Sequence[str] = ("nu_notific", "dt_sin_pri", "dt_notific", "ano", "mes"),
    max_loss_pct: float = MAX_LOAD_LOSS_PCT,
    partitions: Sequence[str] = ("ano", "mes"),
) -> DataFrame:
    """Write the silver table and report its gates as `load_gates` does. Rows in, rows out, missing values and inverted dates are
    counted by the write as they pass, so raw is read once. Distinct keys and partitions come from two columns of what was written."""
    read, passed = Observation(), Observation()
    silver = to_silver(raw.observe(read, rows().alias("_raw")))
    silver.observe(passed, *_gate_counts(required)).write.mode("overwrite").parquet(target)
    spark = raw.sparkSession
    written = spark.read.schema(silver.schema).parquet(target)
    known = {**read.get, **passed.get}
    counts = spark.range(1).select(F.lit(True).alias("_one"), *[F.lit(n).cast("bigint").alias(c) for c, n in known.items()])
    return _gates(counts.join(_distinct_parts(written, key, partitions), "_one"), required, max_loss_pct)


def require_gates(report: DataFrame) -> None:
    """Raise with the names of the gates that failed."""
    failed = [row.verificacao for row in report.filter(~F.col("ok")).collect()]
    if failed:
        raise ValueError("gates failed: " + ", ".join(sorted(failed)))
