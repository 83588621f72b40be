"""Audit log, usage, series and dialogue queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from episurv.operators import audit, dialogue, series, usage
from episurv.plans.audit_log import audit_log
from episurv.plans.cases import table
from episurv.registry import query

LOG = """WITH log AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, ts AS timestamp, event_type,
  CASE WHEN event_type = 'error' AND value > 60 THEN 'critical' WHEN event_type = 'error' THEN 'error'
    WHEN event_type = 'click' AND value < 2 THEN 'warning' WHEN event_type = 'view' THEN 'info' ELSE 'success' END AS status,
  '{"k":"' || json_extract_string(props, '$.k') || '"}' AS details, value AS elapsed_seconds FROM events)"""
TS = "strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp"
OUT = f"event_id, session_id, {TS}, event_type, status, details, elapsed_seconds"


@query(
    "f10_query_logs",
    f"""{LOG} SELECT {OUT} FROM log WHERE event_type = 'error' AND status = 'error'
    AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-25 12:00:00' AND lower(details) LIKE '%"k":"4%'""",
)
def f10(spark, d):
    return audit.query_logs(
        audit_log(spark, d), event_type="error", status="error", start="2024-01-05", end="2024-01-25 12:00:00", term='"K":"4'
    )


@query("f11_errors", f"{LOG} SELECT {OUT} FROM log WHERE status IN ('error', 'critical')")
def f11_errors(spark, d):
    return audit.errors(audit_log(spark, d))


@query("f11_warnings", f"{LOG} SELECT {OUT} FROM log WHERE status = 'warning'")
def f11_warnings(spark, d):
    return audit.warnings(audit_log(spark, d))


@query("f11_by_type", f"{LOG} SELECT {OUT} FROM log WHERE event_type = 'signup'")
def f11_by_type(spark, d):
    return audit.of_type(audit_log(spark, d), "signup")


@query("f11_timeline", f"{LOG} SELECT {OUT} FROM log ORDER BY timestamp, event_id")
def f11_timeline(spark, d):
    return audit.timeline(audit_log(spark, d))


def _json_counts(by: str) -> str:
    return f"""'{{' || string_agg('"' || {by} || '":' || n, ',' ORDER BY {by}) || '}}'"""


@query(
    "a36_session_summary",
    f"""{LOG}, t AS (SELECT session_id, {_json_counts('event_type')} AS j FROM (SELECT session_id, event_type, count(*) AS n FROM log GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT session_id, {_json_counts('status')} AS j FROM (SELECT session_id, status, count(*) AS n FROM log GROUP BY 1, 2) GROUP BY 1)
    SELECT l.session_id, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS start_time, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS end_time,
      (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS duration_seconds, count(*) AS total_events,
      any_value(t.j) AS events_by_type, any_value(s.j) AS events_by_status,
      round(count(*) FILTER (WHERE status IN ('success', 'info')) * 100.0::DOUBLE / count(*), 2) AS success_rate,
      count(*) FILTER (WHERE status IN ('error', 'critical')) AS error_count, count(*) FILTER (WHERE status = 'warning') AS warning_count
    FROM log l JOIN t USING (session_id) JOIN s USING (session_id) GROUP BY l.session_id""",
)
def a36(spark, d):
    return audit.session_summary(audit_log(spark, d))


@query(
    "a37_session_history",
    f"""{LOG} SELECT session_id, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS start_time, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S.%f') AS end_time,
      count(*) AS total_events, count(*) FILTER (WHERE status = 'error') AS error_count, round(avg(elapsed_seconds), 6) AS avg_elapsed_seconds
    FROM log WHERE timestamp >= DATE '2024-01-31' - 7 GROUP BY session_id""",
)
def a37(spark, d):
    out = audit.session_history(audit_log(spark, d), 7, "2024-01-31")
    return out.withColumn("avg_elapsed_seconds", F.round("avg_elapsed_seconds", 6))


@query(
    "a38_error_trend",
    f"""{LOG} SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, event_type, count(*) AS error_count FROM log
    WHERE status IN ('error', 'critical') AND timestamp >= DATE '2024-01-31' - 30 GROUP BY 1, 2""",
)
def a38(spark, d):
    return audit.error_trend(audit_log(spark, d), 30, "2024-01-31")


@query(
    "a39_elapsed_by_type",
    f"""{LOG} SELECT event_type, round(avg(elapsed_seconds), 6) AS avg_seconds, max(elapsed_seconds) AS max_seconds,
    min(elapsed_seconds) AS min_seconds, count(*) AS event_count FROM log WHERE session_id = '7' GROUP BY event_type""",
)
def a39(spark, d):
    return audit.elapsed_by_type(audit_log(spark, d), "7").withColumn("avg_seconds", F.round("avg_seconds", 6))


@query(
    "a40_performance",
    f"""{LOG}, s AS (SELECT session_id, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS dur, count(*) AS n FROM log GROUP BY 1)
    SELECT l.session_id, event_type AS metric, count(*) AS count, round(avg(elapsed_seconds), 6) AS avg_seconds, max(elapsed_seconds) AS max_seconds,
      min(elapsed_seconds) AS min_seconds, round(sum(elapsed_seconds), 6) AS total_seconds,
      round(sum(elapsed_seconds) * 100.0::DOUBLE / any_value(dur), 6) AS percentage, round(any_value(n) / any_value(dur), 9) AS events_per_second
    FROM log l JOIN s USING (session_id) GROUP BY l.session_id, event_type""",
)
def a40(spark, d):
    out = audit.performance(audit_log(spark, d))
    rounded = {c: F.round(c, 6) for c in ("avg_seconds", "total_seconds", "percentage")}
    return out.withColumns({**rounded, "events_per_second": F.round("events_per_second", 9)})


@query(
    "a40_bottlenecks",
    f"""{LOG} SELECT event_id, session_id, elapsed_seconds AS duration_seconds, CASE WHEN elapsed_seconds > 30 THEN 'high' ELSE 'medium' END AS severity
    FROM log WHERE event_type = 'purchase' AND elapsed_seconds > 10""",
)
def a40_bottlenecks(spark, d):
    return audit.bottlenecks(audit_log(spark, d), "purchase")


@query(
    "a41_anomalies",
    f"""{LOG} SELECT session_id, 'high_error_rate' AS type, 'critical' AS severity, CAST(NULL AS VARCHAR) AS metric,
      round(count(*) FILTER (WHERE status = 'error') * 100.0::DOUBLE / count(*), 6) AS valor, 30.0::DOUBLE AS referencia,
      printf('Taxa de erro: %.1f%%', round(count(*) FILTER (WHERE status = 'error') * 100.0::DOUBLE / count(*), 1)) AS details, true AS texto_ok
      FROM log GROUP BY 1 HAVING count(*) FILTER (WHERE status = 'error') > count(*) * 0.3
    UNION ALL SELECT session_id, 'performance_spike', 'warning', event_type,
      round(max(elapsed_seconds), 6), round(sum(elapsed_seconds) / count(*), 6),
      'Spike de #s (média: #s)', true
      FROM log GROUP BY session_id, event_type HAVING count(*) > 1 AND max(elapsed_seconds) > sum(elapsed_seconds) / count(*) * 3
    UNION ALL SELECT session_id, 'excessive_warnings', 'medium', NULL, count(*) FILTER (WHERE status = 'warning'), 2,
      CAST(count(*) FILTER (WHERE status = 'warning') AS VARCHAR) || ' warnings detectados', true
      FROM log GROUP BY 1 HAVING count(*) FILTER (WHERE status = 'warning') > 2""",
)
def a41(spark, d):
    """The numbers in a spike's text are compared with its numbers, to half a hundredth: engines add up in other orders and so round
    halves differently. All else of the texts is compared as it is."""
    out = audit.anomalies(audit_log(spark, d), max_warnings=2)
    spike, number = F.col("type") == "performance_spike", r"(\d+\.\d\d)s"
    said = F.regexp_extract_all("details", F.lit(number), F.lit(1))
    near = [F.abs(F.get(said, n).cast("double") - F.col(c)) < 0.00501 for n, c in enumerate(("valor", "referencia"))]
    return out.withColumns(
        {
            "texto_ok": F.when(spike, (F.size(said) == 2) & near[0] & near[1]).otherwise(True),
            "details": F.when(spike, F.regexp_replace("details", number, "#s")).otherwise(F.col("details")),
            "valor": F.round("valor", 6),
            "referencia": F.round("referencia", 6),
        }
    )


@query(
    "x10_json_details",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    '{"id":' || event_id || ',"type":"' || event_type || '"}' AS details,
    CASE WHEN event_type = 'error' THEN '{}' ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS metadata FROM events""",
)
def x10(spark, d):
    from episurv.functions.documents import parse_metadata

    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), "props")).otherwise(F.col("props"))
    return table(spark, d, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("details"),
        F.to_json(F.transform_values(parse_metadata(broken), lambda k, v: v.cast("int"))).alias("metadata"),
    )


@query(
    "x12_map_details",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS who, 2 AS n FROM events",
)
def x12(spark, d):
    events = table(spark, d, "events")
    details = F.create_map(
        F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string")
    )
    return events.select("event_id", details.alias("m")).select(
        "event_id", F.element_at("m", "k").alias("k"), F.try_element_at("m", F.lit("user")).alias("who"), F.size("m").alias("n")
    )


# --- series per event type --------------------------------------------------------------------

PER_DAY = """WITH daily AS (SELECT event_type, CAST(ts AS DATE) AS dia, count(*) AS n FROM events GROUP BY 1, 2)"""


def _daily(spark, d):
    return (
        table(spark, d, "events")
        .groupBy("event_type", F.to_date("ts").alias("dia"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "w5_strict_moving_mean",
    f"""{PER_DAY} SELECT event_type, CAST(dia AS VARCHAR) AS dia, n, round(CASE WHEN count(*) OVER (PARTITION BY event_type) < 7 THEN n
      WHEN row_number() OVER w >= 7 THEN avg(n) OVER (PARTITION BY event_type ORDER BY dia ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END, 6) AS media_movel
    FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY dia)""",
)
def w5(spark, d):
    out = series.strict_moving_mean(_daily(spark, d), ["event_type"], "dia", "n", 7)
    return out.withColumn("media_movel", F.round("media_movel", 6))


@query(
    "w6_trend",
    f"""{PER_DAY}, steps AS (SELECT *, n - lag(n) OVER (PARTITION BY event_type ORDER BY dia) AS step FROM daily)
    SELECT event_type, count(*) AS pontos, count(*) FILTER (WHERE step > 0) AS altas, count(*) FILTER (WHERE step < 0) AS quedas,
      CASE WHEN count(step) = 0 THEN 'insufficient_data' WHEN count(*) FILTER (WHERE step > 0) > count(step) * 0.6 THEN 'crescente'
        WHEN count(*) FILTER (WHERE step < 0) > count(step) * 0.6 THEN 'decrescente' ELSE 'estável' END AS tendencia
    FROM steps GROUP BY event_type""",
)
def w6(spark, d):
    return series.trend(_daily(spark, d), ["event_type"], "dia", "n")


@query(
    "w7_first_to_last_growth",
    f"""{PER_DAY} SELECT event_type, arg_min(n, dia) AS primeiro, arg_max(n, dia) AS ultimo,
    round(CASE WHEN count(*) < 2 OR arg_min(n, dia) = 0 THEN 0 ELSE (arg_max(n, dia) - arg_min(n, dia))::DOUBLE / arg_min(n, dia) * 100 END, 6) AS crescimento_pct
    FROM daily GROUP BY event_type""",
)
def w7(spark, d):
    out = series.first_to_last_growth(_daily(spark, d), ["event_type"], "dia", "n")
    return out.withColumn("crescimento_pct", F.round("crescimento_pct", 6))


@query(
    "w8_peaks",
    f"""{PER_DAY} SELECT event_type, CAST(dia AS VARCHAR) AS dia, n, posicao FROM (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS posicao,
      lag(n) OVER w AS a, lead(n) OVER w AS b, max(n) OVER (PARTITION BY event_type) AS top FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY dia))
    WHERE n > a AND n > b AND n > top * 0.9""",
)
def w8(spark, d):
    return series.peaks(_daily(spark, d), ["event_type"], "dia", "n")


# --- usage ------------------------------------------------------------------------------------


@query(
    "st3_rate_usage",
    """SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, count(*) OVER m AS no_ultimo_minuto, count(*) OVER h AS na_ultima_hora,
      count(*) OVER m * 100.0::DOUBLE / 100 AS uso_minuto_pct, count(*) OVER h * 100.0::DOUBLE / 500 AS uso_hora_pct
    FROM events WINDOW m AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW),
      h AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)""",
)
def st3(spark, d):
    return usage.rate_usage(table(spark, d, "events"), "user_id", "ts", "event_id")


LIMIT_MINUTE, LIMIT_HOUR = 1, 1


@query(
    "st2_rate_limit",
    f"""WITH RECURSIVE numbered AS (
      SELECT user_id, event_id, epoch_us(ts) AS t_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    replay AS (
      SELECT user_id, event_id, rn, [t_us] AS admitted, 'permitido' AS veredito FROM numbered WHERE rn = 1
      UNION ALL
      SELECT user_id, event_id, rn, CASE WHEN v = 'permitido' THEN list_append(recent, t_us) ELSE recent END, v FROM (
        SELECT *, CASE WHEN len(list_filter(recent, lambda x: x > t_us - 60000000)) >= {LIMIT_MINUTE} THEN 'negado_minuto'
          WHEN len(recent) >= {LIMIT_HOUR} THEN 'negado_hora' ELSE 'permitido' END AS v
        FROM (SELECT n.user_id, n.event_id, n.rn, n.t_us, list_filter(r.admitted, lambda x: x > n.t_us - 3600000000) AS recent
          FROM replay r JOIN numbered n ON n.user_id = r.user_id AND n.rn = r.rn + 1)))
    SELECT user_id, event_id, veredito FROM replay""",
)
def st2(spark, d):
    return usage.rate_limit(
        table(spark, d, "events"), "user_id", "ts", "event_id", per_minute=LIMIT_MINUTE, per_hour=LIMIT_HOUR
    )


@query(
    "w10_conversation_history",
    """WITH pairs AS (
      SELECT q.conv_id, q.turn, q.text AS pergunta, a.text AS resposta,
        count(a.text) OVER (PARTITION BY q.conv_id ORDER BY q.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anteriores
      FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
      WHERE q.role = 'user'),
    past AS (SELECT p.conv_id, p.turn, count(*) AS lembrados,
        string_agg('P: ' || e.pergunta || chr(10) || 'R: ' || substr(e.resposta, 1, 100) || '...' || chr(10) || chr(10), '' ORDER BY e.turn) AS texto
      FROM pairs p JOIN pairs e ON e.conv_id = p.conv_id AND e.resposta IS NOT NULL AND e.anteriores < p.anteriores AND e.anteriores >= p.anteriores - 3
      GROUP BY 1, 2)
    SELECT conv_id, turn, CAST(coalesce(lembrados, 0) AS INTEGER) AS lembrados, CASE WHEN texto IS NULL THEN pergunta
      ELSE 'Histórico recente:' || chr(10) || texto || chr(10) || 'Pergunta atual: ' || pergunta END AS contexto
    FROM pairs LEFT JOIN past USING (conv_id, turn)""",
)
def w10(spark, d):
    return dialogue.with_history(table(spark, d, "conversations"))
