"""Audit-log analytics: filters, session summaries, performance and anomalies.

Sessions are first counted per (session, type, status), which combines in the map tasks, so a
session that holds a large share of the log reaches the second step as a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episurv.functions.columns import as_col
from episurv.operators.filters import since_days

# Status names and thresholds.
ERRORS = ["error", "critical"]
PASSED = ["success", "info"]
WARNING = "warning"
MEDIUM_SECONDS, HIGH_SECONDS = 10, 30
ERROR_SHARE, SPIKE_FACTOR, MAX_WARNINGS = 0.3, 3, 10


def _seconds(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1e6)


# --- filters --------------------------------------------------------------------------------


def query_logs(
    log: DataFrame,
    event_type: str | None = None,
    status: str | None = None,
    start: str | None = None,
    end: str | None = None,
    term: str | None = None,
) -> DataFrame:
    """Events by type, status, inclusive time bounds and a term in the serialised details."""
    out = log
    if event_type:
        out = out.filter(F.col("event_type") == event_type)
    if status:
        out = out.filter(F.col("status") == status)
    kind = log.schema["timestamp"].dataType
    if start:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast(kind))
    if end:
        out = out.filter(F.col("timestamp") <= F.lit(end).cast(kind))
    if term:
        out = out.filter(F.lower(F.to_json("details")).contains(term.lower()))
    return out


def errors(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status").isin(*ERRORS))


def warnings(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status") == WARNING)


def of_type(log: DataFrame, event_type: str) -> DataFrame:
    return log.filter(F.col("event_type") == event_type)


def timeline(log: DataFrame, tie: str = "event_id") -> DataFrame:
    """Events in time order; ties by id."""
    return log.orderBy("timestamp", tie)


# --- sessions -------------------------------------------------------------------------------


def per_type_measures() -> list[Column]:
    """Measures that can be counted in parts and added up later."""
    return [
        F.count(F.lit(1)).alias("_n"),
        F.min("timestamp").alias("_start"),
        F.max("timestamp").alias("_end"),
        F.sum("elapsed_seconds").alias("_sum"),
        F.max("elapsed_seconds").alias("_max"),
        F.min("elapsed_seconds").alias("_min"),
    ]


def _decimal(value: str) -> Column:
    """A number as its decimal text says; NULL where that has more than ten places or 18 digits before them."""
    text = F.col(value).try_cast("decimal(28,10)")
    return F.when(text.cast("double") == F.col(value), text)


def _exact(part: Column, value: str) -> Column:
    """Sum of decimals; NULL unless every value has one."""
    return F.when(F.count(part) == F.count(value), F.try_sum(part))


def _seconds_sum() -> Column:
    """The sum of a metric's parts. Doubles added up in another order differ in the last digit, which decides halves and bounds; of
    decimals the sum is rounded once. Where a value is no short decimal, doubles are added."""
    return F.coalesce(_exact(F.col("_exact"), "_sum").cast("double"), F.sum("_sum"))


def _per_type(log: DataFrame) -> DataFrame:
    exact = _exact(_decimal("elapsed_seconds"), "elapsed_seconds").alias("_exact")
    return log.groupBy("session_id", "event_type", "status").agg(*per_type_measures(), exact)


def _sum_if(condition: Column, value: str = "_n") -> Column:
    return F.sum(F.when(condition, F.col(value)).otherwise(F.lit(0)))


def session_summary(log: DataFrame) -> DataFrame:
    """Duration, events by type and status, success rate, errors and warnings per session."""
    return summarise_sessions(_per_type(log))


def summarise_sessions(counted: DataFrame) -> DataFrame:
    """Session summaries from counts per session, type and status, however finely split."""
    by_type = counted.groupBy("session_id", "event_type").agg(
        F.sum("_n").alias("_n"),
        F.min("_start").alias("_start"),
        F.max("_end").alias("_end"),
        _sum_if(F.col("status").isin(*PASSED)).alias("_passed"),
        *[
            _sum_if(F.col("status") == s).alias(f"_{s}")
            for s in ("success", "info", WARNING, "error", "critical")
        ],
    )

    status_names = ("critical", "error", "info", "success", WARNING)
    statuses = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(s).alias("k"), F.sum(f"_{s}").alias("v")) for s in status_names]),
            lambda e: e["v"] > 0,
        )
    )
    types = F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "_n"))))
    return by_type.groupBy("session_id").agg(
        F.min("_start").alias("start_time"),
        F.max("_end").alias("end_time"),
        _seconds(F.max("_end"), F.min("_start")).alias("duration_seconds"),
        F.sum("_n").alias("total_events"),
        types.alias("events_by_type"),
        statuses.alias("events_by_status"),
        F.round(F.sum("_passed") * 100.0 / F.sum("_n"), 2).alias("success_rate"),
        F.sum(F.col("_error") + F.col("_critical")).alias("error_count"),
        F.sum(f"_{WARNING}").alias("warning_count"),
    )


def session_history(log: DataFrame, days: int = 7, anchor: str | None = None) -> DataFrame:
    """Sessions of the last days; only status `error` counts as an error here."""
    return (
        log.filter(since_days("timestamp", days, anchor))
        .groupBy("session_id")
        .agg(
            F.min("timestamp").alias("start_time"),
            F.max("timestamp").alias("end_time"),
            F.count(F.lit(1)).alias("total_events"),
            F.count_if(F.col("status") == "error").alias("error_count"),
            F.avg("elapsed_seconds").alias("avg_elapsed_seconds"),
        )
        .orderBy(F.desc("start_time"), "session_id")
    )


def error_trend(log: DataFrame, days: int = 30, anchor: str | None = None) -> DataFrame:
    return (
        errors(log)
        .filter(since_days("timestamp", days, anchor))
        .groupBy(F.to_date("timestamp").alias("date"), "event_type")
        .agg(F.count(F.lit(1)).alias("error_count"))
        .orderBy(F.desc("date"), F.desc("error_count"), "event_type")
    )


def elapsed_by_type(log: DataFrame, session_id: str) -> DataFrame:
    """Elapsed seconds since session start, per event type of one session."""
    return (
        log.filter(F.col("session_id") == session_id)
        .groupBy("event_type")
        .agg(
            F.avg("elapsed_seconds").alias("avg_seconds"),
            F.max("elapsed_seconds").alias("max_seconds"),
            F.min("elapsed_seconds").alias("min_seconds"),
            F.count(F.lit(1)).alias("event_count"),
        )
        .orderBy(F.desc("avg_seconds"), "event_type")
    )


# --- performance ----------------------------------------------------------------------------


def _metrics(log: DataFrame) -> DataFrame:
    return _per_type(log).groupBy("session_id", F.col("event_type").alias("metric")).agg(
        F.sum("_n").alias("count"),
        _seconds_sum().alias("total_seconds"),
        F.max("_max").alias("max_seconds"),
        F.min("_min").alias("min_seconds"),
        F.min("_start").alias("_start"),
        F.max("_end").alias("_end"),
    )


def performance(log: DataFrame) -> DataFrame:
    """Durations per session and metric, with their share of the session and its event rate."""
    session = Window.partitionBy("session_id")
    total = _seconds(F.max("_end").over(session), F.min("_start").over(session))
    return (
        _metrics(log)
        .withColumns({"total_duration_seconds": total, "_events": F.sum("count").over(session)})
        .select(
            "session_id",
            "metric",
            "count",
            (F.col("total_seconds") / F.col("count")).alias("avg_seconds"),
            "max_seconds",
            "min_seconds",
            "total_seconds",
            F.coalesce(
                F.try_divide(F.col("total_seconds") * 100.0, F.col("total_duration_seconds")), F.lit(0.0)
            ).alias("percentage"),
            F.coalesce(
                F.try_divide(F.col("_events").cast("double"), F.col("total_duration_seconds")), F.lit(0.0)
            ).alias("events_per_second"),
        )
    )


def bottlenecks(
    log: DataFrame,
    event_type: str,
    duration: str | Column = "elapsed_seconds",
    medium: float = MEDIUM_SECONDS,
    high: float = HIGH_SECONDS,
) -> DataFrame:
    """Completed steps that took too long."""
    took = as_col(duration)
    return log.filter((F.col("event_type") == event_type) & (took > medium)).select(
        "event_id", "session_id", took.alias("duration_seconds"), F.when(took > high, "high").otherwise("medium").alias("severity")
    )


def anomalies(
    log: DataFrame,
    error_share: float = ERROR_SHARE,
    spike: float = SPIKE_FACTOR,
    max_warnings: int = MAX_WARNINGS,
) -> DataFrame:
    """Per session: a high error share, a duration far above its mean, too many warnings."""
    counted = _per_type(log)
    none = F.lit(None).cast("string")
    per_session = counted.groupBy("session_id").agg(
        F.sum("_n").alias("_all"),
        _sum_if(F.col("status") == "error").alias("_errors"),
        _sum_if(F.col("status") == WARNING).alias("_warnings"),
    )
    error_pct = F.col("_errors") * 100.0 / F.col("_all")

    def row(kind: str, severity: str, metric: Column, value: Column, bound: Column, text: Column) -> list[Column]:
        return [
            F.col("session_id"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), metric.alias("metric"),
            value.cast("double").alias("valor"), bound.cast("double").alias("referencia"), text.alias("details"),
        ]

    high = per_session.filter(F.col("_errors") > F.col("_all") * error_share).select(
        *row("high_error_rate", "critical", none, error_pct, F.lit(error_share * 100),
             F.format_string("Taxa de erro: %.1f%%", F.round(error_pct, 1)))
    )
    many = per_session.filter(F.col("_warnings") > max_warnings).select(
        *row("excessive_warnings", "medium", none, F.col("_warnings"), F.lit(max_warnings),
             F.concat(F.col("_warnings").cast("string"), F.lit(" warnings detectados")))
    )
    mean = F.col("_sum") / F.col("_n")
    spikes = (
        counted.groupBy("session_id", "event_type")
        .agg(F.sum("_n").alias("_n"), _seconds_sum().alias("_sum"), F.max("_max").alias("_max"))
        .filter((F.col("_n") > 1) & (F.col("_max") > mean * spike))
        .select(
            *row("performance_spike", "warning", F.col("event_type"), F.col("_max"), mean,
                 F.format_string("Spike de %.2fs (média: %.2fs)", F.round("_max", 2), F.round(mean, 2)))
        )
    )
    return high.unionByName(spikes).unionByName(many)


# --- violations -----------------------------------------------------------------------------


def violation_summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("violation_type", "severity").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("blocked")).alias("bloqueadas")
    )


def recent_violations(violations: DataFrame, n: int = 10, tie: Sequence[str] = ("query_id",)) -> DataFrame:
    return violations.orderBy(F.desc("timestamp"), *[F.desc(c) for c in tie]).limit(n)


def critical_violations(violations: DataFrame) -> DataFrame:
    return violations.filter(F.col("severity") == "critical")


def drop_old_violations(violations: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Keep what is newer than the given number of days before now."""
    cutoff = F.lit(now).cast(violations.schema["timestamp"].dataType) - F.make_dt_interval(F.lit(days))
    return violations.filter(F.col("timestamp") > cutoff)
