"""Layouts, merging gold, details as VARIANT, windowed streams: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from episurv.functions import semistructured as semi
from episurv.operators import quality as q
from episurv.plans import gold, incremental
from episurv.plans.audit_log import as_audit_log, audit_log
from episurv.plans.cases import raw_cases, table
from episurv.plans.silver import silver_cases, silver_of
from episurv.registry import ORACLES, query
from episurv.registry.audit_queries import LOG, OUT
from episurv.registry.io_queries import _event_stream
from episurv.registry.sql import SILVER
from episurv.session import scratch_path
from episurv.sources import layout
from episurv.sources import tables as tb
from episurv.streaming.batches import run_available
from episurv.streaming.windows import closed_windows, error_windows


@query("s10_morton_layout", ORACLES["s10_cluster_layout"])
def s10_morton(spark, d):
    target = scratch_path(spark, "morton")
    cases = silver_of(spark, d).select("nu_notific", "ano", "mes", "sg_uf", "dt_sin_pri")
    layout.morton_layout(cases, target, ["ano"], ["dt_sin_pri", "sg_uf"])
    return tb.read_table(spark, target)


@query("s11_lookup_events", f"{LOG} SELECT {OUT} FROM log WHERE session_id IN (SELECT min(session_id) FROM log UNION SELECT max(session_id) FROM log)")
def s11_lookup(spark, d):
    target = scratch_path(spark, "audit")
    log = audit_log(spark, d)
    layout.write_lookup_log(log, target, {"session_id": 10_000, "event_id": 1_000_000})
    ends = log.agg(F.min("session_id"), F.max("session_id")).first()
    return layout.find_rows(spark, target, "session_id", sorted(set(ends)))


@query(
    "s13_bucketed_join",
    "SELECT doc_id, lang, len(embedding) AS dim, label FROM documents JOIN embeddings ON vec_id = doc_id",
)
def s13_bucketed(spark, d):
    target = scratch_path(spark, "bucketed")
    run = target.rsplit("-", 1)[1]
    names = [f"episurv_{kind}_{run}" for kind in ("documents", "embeddings")]
    layout.write_bucketed(table(spark, d, "documents").select("doc_id", "lang"), names[0], f"{target}/documents", "doc_id", 8)
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    layout.write_bucketed(vectors, names[1], f"{target}/embeddings", "doc_id", 8)
    joined = spark.table(names[0]).join(spark.table(names[1]), "doc_id")
    found = scratch_path(spark, "joined")
    joined.select("doc_id", "lang", F.size("embedding").alias("dim"), "label").write.parquet(found)
    for name in names:
        spark.sql(f"DROP TABLE {name}")  # external tables: their files stay
    return spark.read.parquet(found)


def _merging_gold(spark, d):
    """All months, then one of them again."""
    silver, folder = scratch_path(spark, "silver"), scratch_path(spark, "gold")
    silver_of(spark, d).write.partitionBy("ano", "mes").parquet(silver)
    incremental.update_months(spark.read.parquet(silver), folder)
    month = [tuple(r) for r in spark.read.parquet(silver).agg(F.max(F.struct("ano", "mes")).alias("m")).select("m.*").collect() if r[0] is not None]
    if month:
        incremental.update_months(incremental.read_months(spark, silver, month), folder, month)
    return folder


@query("a12_merged_months", ORACLES["a12_monthly_metrics"])
def a12_merged(spark, d):
    return incremental.monthly_table(spark, _merging_gold(spark, d)).select(*gold.monthly_metrics(silver_of(spark, d), key_is_unique=True).columns)


@query("a9_merged_distinct", f"{SILVER} SELECT count(DISTINCT nu_notific) AS casos_unicos FROM silver WHERE ano_mes BETWEEN '1996-03' AND '1998-09'")
def a9_merged(spark, d):
    return incremental.distinct_cases(spark, _merging_gold(spark, d), "1996-03", "1998-09")


@query("a18_merged_kpis", ORACLES["a18_national_kpis"])
def a18_merged(spark, d):
    return incremental.national_table(spark, _merging_gold(spark, d))


_BROKEN = "CASE WHEN event_id % 50 = 0 THEN left(props, 5) WHEN event_id % 77 = 0 THEN NULL ELSE props END"


@query(
    "x10_variant_details",
    f"""WITH e AS (SELECT event_id, {_BROKEN} AS text FROM events)
    SELECT event_id, CASE WHEN json_valid(text) THEN CAST(json_extract(text, '$.k') AS BIGINT) END AS k,
      CASE WHEN NOT json_valid(text) THEN text END AS malformed FROM e""",
)
def x10_variant(spark, d):
    broken = table(spark, d, "events").select("event_id", F.expr(_BROKEN).alias("text"))
    return semi.with_details(broken, "text").select("event_id", semi.detail("details", "$.k", "bigint").alias("k"), "malformed")


@query("q13_gates_of_the_write", ORACLES["q13_load_gates"])
def q13_written(spark, d):
    return q.write_through_gates(raw_cases(spark, d), silver_cases, scratch_path(spark, "silver"))


@query("st4_error_windows", ORACLES["st4_error_trend"])
def st4_windows(spark, d):
    target = scratch_path(spark, "windows")
    log = as_audit_log(_event_stream(spark, d, clock=True))
    run_available(error_windows(log, "60 days"), target, scratch_path(spark, "state"), allow_late=False)
    return closed_windows(spark.read.parquet(target))
