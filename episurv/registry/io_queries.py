"""Sources, sinks, SQL text and streams: written to the shared folder and read back."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from episurv.operators import sqltool
from episurv.operators.quality import CHECK_SCHEMA, all_checks, check_log
from episurv.plans import gold, views
from episurv.plans.audit_log import as_audit_log, audit_log
from episurv.plans.cases import raw_cases, table
from episurv.plans.silver import silver_of, written_silver
from episurv.registry import query
from episurv.registry.audit_queries import LIMIT_HOUR, LIMIT_MINUTE, LOG, OUT
from episurv.registry.cases_queries import FEATURE_OUT
from episurv.registry.gold_queries import KPI_LONG, KPIS, MONTHLY, STATES
from episurv.registry.quality_queries import ALL, CHECK_COLS
from episurv.registry import ORACLES
from episurv.registry.sql import RAW, SILVER
from episurv.session import scratch_path
from episurv.sources import delimited as csv
from episurv.sources import tables as tb
from episurv.sources.multiline import ingest_records, scan_records
from episurv.streaming import audit_stream, index_sync
from episurv.streaming.batches import file_stream, run_available
from episurv.streaming.rate_limit import rate_limit_stream

# Spark writes folders, so a source here is a folder named after the file it stands for.
PATTERN = "src=INFLUD{yy}-*.csv"
YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
TEXT_COLUMNS = """NU_NOTIFIC, DT_NOTIFIC, DT_SIN_PRI, SEM_PRI, CS_SEXO, NU_IDADE_N, TP_IDADE, SG_UF, CO_MUN_RES, FEBRE,
  nullif(TOSSE, '') AS TOSSE, DISPNEIA, HOSPITAL, UTI, EVOLUCAO, VACINA, DT_INTERNA, DT_ENTUTI, DT_EVOLUCA"""


def _csv_folder(spark, d, parts=4) -> str:
    """The raw notifications as delimited files, one source of several files per year."""
    path = scratch_path(spark, "csv")
    raw = raw_cases(spark, d).withColumn("src", F.concat(F.lit("INFLUD"), F.substring(F.col("ANO_DADOS").cast("string"), 3, 2), F.lit("-cases.csv")))
    raw, options = raw.drop("ANO_DADOS"), {"header": "true", "sep": ";", "encoding": "ISO-8859-1", "escape": '"'}
    if parts == 1:  # a write by years sorts them in memory; a task that reads one year of the written rows holds a batch
        years = scratch_path(spark, "csv-years")
        raw.write.parquet(years)
        written = spark.read.parquet(years)

        def write(year: str) -> None:
            rows = written.filter(F.col("src") == year).drop("src")
            rows.coalesce(1).write.options(**options).csv(f"{path}/src={year}")

        names = [r["src"] for r in written.select("src").distinct().collect()]
        with ThreadPoolExecutor(len(YEARS)) as pool:  # a job of one task for each year, all at once
            list(pool.map(write, names))
        return path
    (
        raw.repartition("src", F.pmod(F.xxhash64("NU_NOTIFIC"), F.lit(parts))).write.partitionBy("src")
        .options(**options).csv(path)
    )
    return path


@query("s1_scan_delimited", f"{RAW} SELECT {TEXT_COLUMNS} FROM raw")
def s1(spark, d):
    return csv.scan_delimited(spark, f"{_csv_folder(spark, d)}/src=*")


@query("s1_scan_single_lines", ORACLES["s1_scan_delimited"])
def s1_single(spark, d):
    """These files hold one record per line, so a large one may be split."""
    return csv.scan_delimited(spark, f"{_csv_folder(spark, d)}/src=*", multiLine="false")


@query(
    "s1_scan_records",
    r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text, lang, source FROM documents""",
)
def s1_records(spark, d):
    """Whole texts with their line breaks, quotes and separators, in files that are read in splits."""
    path = scratch_path(spark, "csv-texts")
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source")
    texts.write.options(header="true", sep=";", encoding="UTF-8", escape='"').csv(path)
    return scan_records(spark, path, texts.columns, encoding="UTF-8")


@query("s2_scan_year", f"{RAW} SELECT {TEXT_COLUMNS} FROM raw WHERE ANO_DADOS = 1997")
def s2(spark, d):
    return csv.scan_year(spark, _csv_folder(spark, d), 1997, PATTERN)


@query(
    "s3_list_sources",
    f"{RAW} SELECT 'src=INFLUD' || substr(CAST(ANO_DADOS AS VARCHAR), 3) || '-cases.csv' AS nome, CAST(1 AS BIGINT) AS arquivos, true AS com_conteudo FROM raw GROUP BY ANO_DADOS",
)
def s3(spark, d):
    found = csv.require_sources(csv.list_sources(spark, _csv_folder(spark, d, parts=1)))
    return found.select(F.replace("nome", F.lit("%3D"), F.lit("=")).alias("nome"), "arquivos", (F.col("bytes") > 0).alias("com_conteudo"))


@query(
    "s4_dry_run",
    f"""{RAW}, y AS (SELECT ANO_DADOS AS ano, count(*) AS linhas, 19 AS colunas, CAST(NULL AS VARCHAR) AS erro FROM raw GROUP BY 1
      UNION ALL SELECT 2010, 0, 0, 'PATH_NOT_FOUND')
    SELECT *, CAST(sum(linhas) OVER () AS BIGINT) AS total_linhas, erro IS NULL AS ok FROM y""",
)
def s4(spark, d):
    return csv.dry_run(spark, _csv_folder(spark, d), [*YEARS, 2010], PATTERN)


@query(
    "s5_ingest_metadata",
    f"{RAW} SELECT {TEXT_COLUMNS}, ANO_DADOS, true AS has_time, 'INFLUD' || substr(CAST(ANO_DADOS AS VARCHAR), 3) || '-cases.csv' AS fonte FROM raw",
)
def s5(spark, d):
    return _bronze(spark, d).withColumns(
        {"has_time": F.col("_ingested_at").isNotNull(), "fonte": F.regexp_extract("_source_file", r"(INFLUD\d\d-cases\.csv)", 1)}
    ).drop("_ingested_at", "_source_file")


def _bronze(spark, d):
    return csv.ingest(spark, _csv_folder(spark, d), YEARS, PATTERN)


@query("s6_union_years", f"{RAW} SELECT {TEXT_COLUMNS}, ANO_DADOS FROM raw")
def s6(spark, d):
    return _bronze(spark, d).drop("_ingested_at", "_source_file")


@query("s6_ingest_records", ORACLES["s5_ingest_metadata"])
def s6_records(spark, d):
    """The bronze table from files that are read in splits."""
    bronze = ingest_records(spark, _csv_folder(spark, d), YEARS, PATTERN)
    return bronze.withColumns(
        {"has_time": F.col("_ingested_at").isNotNull(), "fonte": F.regexp_extract("_source_file", r"(INFLUD\d\d-cases\.csv)", 1)}
    ).drop("_ingested_at", "_source_file")


@query(
    "u1_union_tolerant",
    f"""{RAW} SELECT NU_NOTIFIC, UTI, CAST(NULL AS VARCHAR) AS VACINA FROM raw WHERE ANO_DADOS < 1998
    UNION ALL SELECT NU_NOTIFIC, NULL, VACINA FROM raw WHERE ANO_DADOS >= 1998""",
)
def u1(spark, d):
    raw = raw_cases(spark, d)
    return csv.union_years(
        [
            raw.filter("ANO_DADOS < 1998").select("NU_NOTIFIC", "UTI"),
            raw.filter("ANO_DADOS >= 1998").select("NU_NOTIFIC", "VACINA"),
        ]
    )


@query("s7_write_table", f"{RAW} SELECT * FROM raw")
def s7(spark, d):
    target = scratch_path(spark, "bronze")
    for _ in range(2):
        tb.write_table(raw_cases(spark, d), target)
    return tb.read_table(spark, target)


@query(
    "s8_reconcile_write",
    f"""{RAW} SELECT 'row_count_match' AS verificacao, count(*) AS encontrado, count(*) AS esperado, true AS ok FROM raw
    UNION ALL SELECT 'columns_count', 22, 22, true UNION ALL SELECT 'has_metadata', 3, 3, true
    UNION ALL SELECT 'all_years_present', count(DISTINCT ANO_DADOS), 7, count(DISTINCT ANO_DADOS) = 7 FROM raw""",
)
def s8(spark, d):
    target, ledger = scratch_path(spark, "bronze"), scratch_path(spark, "ledger")
    written = tb.write_with_ledger(_bronze(spark, d), target, ledger, "INGEST")
    return tb.reconcile_write(tb.read_table(spark, target), written, 22, YEARS)


@query("s9_write_partitioned", f"{SILVER} SELECT nu_notific, {FEATURE_OUT} FROM silver")
def s9(spark, d):
    target = scratch_path(spark, "silver")
    tb.write_partitioned(silver_of(spark, d), target, ["ano", "mes"])
    names = [c.strip() for c in FEATURE_OUT.split(",")]
    return tb.read_table(spark, target).select("nu_notific", *names)


@query("s10_cluster_layout", f"{SILVER} SELECT nu_notific, ano, mes, sg_uf, CAST(dt_sin_pri AS VARCHAR) AS dt_sin_pri FROM silver")
def s10(spark, d):
    target = scratch_path(spark, "clustered")
    cases = silver_of(spark, d).select("nu_notific", "ano", "mes", "sg_uf", "dt_sin_pri")
    name = f"episurv_clustered_{target.rsplit('-', 1)[1]}"
    tb.cluster_layout(cases, target, ["ano"], ["dt_sin_pri", "sg_uf"], name=name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return tb.read_table(spark, target)


@query("s11_append_log", f"{RAW}, {ALL} SELECT {CHECK_COLS}, validation_id FROM checks, (VALUES ('run-1'), ('run-2')) AS v(validation_id)")
def s11(spark, d):
    target = scratch_path(spark, "checks")
    checks = all_checks(raw_cases(spark, d))
    for run in ("run-1", "run-2"):
        log = check_log(checks, run)
        tb.append_log(log, target, {**CHECK_SCHEMA, "validation_id": "string", "timestamp": "timestamp"})
    return tb.read_table(spark, target).drop("timestamp")


@query("s11_append_events", f"{LOG} SELECT {OUT} FROM log")
def s11_events(spark, d):
    target = scratch_path(spark, "audit")
    tb.append_log(audit_log(spark, d), target)
    return tb.read_table(spark, target)


@query(
    "s12_append_snapshot",
    f"""{SILVER}, {KPIS}, {KPI_LONG} SELECT *, '2024-01-01' AS data_snapshot, CAST(NULL AS INTEGER) AS versao FROM kpi_long
    UNION ALL SELECT *, '2024-02-01', 2 FROM kpi_long""",
)
def s12(spark, d):
    target = scratch_path(spark, "kpis")
    kpis = gold.kpi_rows(gold.national_kpis(silver_of(spark, d)))
    tb.append_snapshot(kpis, target, "2024-01-01")
    tb.append_snapshot(kpis.withColumn("versao", F.lit(2)), target, "2024-02-01")
    return tb.read_snapshots(spark, target)


@query(
    "s13_write_embeddings",
    """SELECT vec_id, CAST(label % 3 AS VARCHAR) AS semantic_type, len(embedding) AS dim, copia, (SELECT 2 * count(*) FROM embeddings) AS total
    FROM embeddings, (VALUES (1), (2)) AS v(copia)""",
)
def s13(spark, d):
    target = scratch_path(spark, "vectors")
    rows = table(spark, d, "embeddings").withColumn("semantic_type", (F.col("label") % 3).cast("string"))
    tb.write_embeddings(rows.withColumn("copia", F.lit(1)), target, recreate=True)
    total = tb.write_embeddings(rows.withColumn("copia", F.lit(2)), target)
    stored = spark.read.schema("vec_id bigint, embedding array<float>, copia int, semantic_type string").parquet(target)
    return stored.select("vec_id", "semantic_type", F.size("embedding").alias("dim"), "copia", F.lit(total).cast("bigint").alias("total"))


def _profile(spark, d):
    target = scratch_path(spark, "profile")
    name = f"episurv_profile_{target.rsplit('-', 1)[1]}"
    silver = silver_of(spark, d).select("nu_notific", "sg_uf", "ano", "mes")
    silver.write.format("parquet").option("path", target).partitionBy("ano", "mes").saveAsTable(name)
    tb.analyze(spark, name)
    found = tb.table_profile(spark, name)  # runs its commands now, so the table can go
    spark.sql(f"DROP TABLE {name}")
    return found


@query(
    "s14_table_profile",
    f"""{SILVER} SELECT * FROM (VALUES ('describe', 'nu_notific', 'string'), ('describe', 'sg_uf', 'string'), ('describe', 'ano', 'int'),
    ('describe', 'mes', 'int'), ('describe', 'Type', 'EXTERNAL'), ('describe', 'Provider', 'parquet')) AS t(secao, nome, valor)
    UNION ALL SELECT 'describe', 'Statistics', count(*) || ' rows' FROM silver
    UNION ALL SELECT 'partitions', 'count', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT ano, mes FROM silver)
    UNION ALL SELECT * FROM (SELECT DISTINCT 'partition', 'ano=' || ano || '/mes=' || mes AS nome, CAST(NULL AS VARCHAR) FROM silver ORDER BY nome LIMIT 10)""",
)
def s14(spark, d):
    """All but what differs from run to run: names, places, times, bytes."""
    fixed = ["nu_notific", "sg_uf", "ano", "mes", "Type", "Provider", "Statistics"]
    found = _profile(spark, d).filter((F.col("secao") != "describe") | F.col("nome").isin(fixed)).distinct()
    return found.withColumn("valor", F.when(F.col("nome") == "Statistics", F.regexp_extract("valor", r"\d+ rows", 0)).otherwise(F.col("valor")))


@query(
    "s14_partition_profile",
    f"""{SILVER}, p AS (SELECT DISTINCT 'ano=' || ano || '/mes=' || mes AS nome FROM silver)
    SELECT 'partitions' AS secao, 'count' AS nome, CAST(count(*) AS VARCHAR) AS valor FROM p
    UNION ALL SELECT * FROM (SELECT 'partition', nome, NULL FROM p ORDER BY nome LIMIT 10)""",
)
def s14_partitions(spark, d):
    return _profile(spark, d).filter(F.col("secao") != "describe")


@query(
    "s15_run_ledger",
    f"""{SILVER} SELECT CAST(0 AS BIGINT) AS version, 'INGEST' AS operation, count(*) AS num_rows FROM raw
    UNION ALL SELECT 1, 'SILVER', count(*) FROM silver""",
)
def s15(spark, d):
    ledger = scratch_path(spark, "ledger")
    tb.write_with_ledger(raw_cases(spark, d), scratch_path(spark, "bronze"), ledger, "INGEST", "run-1")
    tb.write_with_ledger(silver_of(spark, d), scratch_path(spark, "silver"), ledger, "SILVER", "run-1")
    return tb.read_ledger(spark, ledger).select("version", "operation", "num_rows")


@query(
    "s16_write_stats_json",
    f"""{RAW} SELECT 'bronze' AS "table", count(*) AS total_rows, CAST(20 AS BIGINT) AS total_columns,
    '[' || string_agg(DISTINCT CAST(ANO_DADOS AS VARCHAR), ',' ORDER BY CAST(ANO_DADOS AS VARCHAR)) || ']' AS years_processed, true AS validation_passed FROM raw""",
)
def s16(spark, d):
    path = scratch_path(spark, "stats")
    tb.write_stats_json(tb.ingestion_stats(raw_cases(spark, d), "bronze"), path)
    return spark.read.json(path).drop("timestamp")


@query("s17_widen_column", f"{RAW} SELECT NU_NOTIFIC, CAST(ANO_DADOS AS VARCHAR) AS ANO_DADOS FROM raw")
def s17(spark, d):
    source, target = scratch_path(spark, "narrow"), scratch_path(spark, "wide")
    tb.write_table(raw_cases(spark, d).select("NU_NOTIFIC", "ANO_DADOS"), source)
    tb.widen_column(spark, source, target, "ANO_DADOS")
    return tb.read_table(spark, target)


_LOG_COLUMNS = "event_id bigint, session_id string, timestamp timestamp_ntz, event_type string, status string, {}, elapsed_seconds double"


@query("s18_export_json", f"{LOG} SELECT {OUT} FROM log")
def s18_json(spark, d):
    path = scratch_path(spark, "export")
    tb.export_logs(audit_log(spark, d), path, "json")
    return spark.read.schema(_LOG_COLUMNS.format("details map<string,string>")).options(**tb.EXPORT_TIMES).json(path)


@query("s18_export_csv", f"{LOG} SELECT {OUT} FROM log")
def s18_csv(spark, d):
    path = scratch_path(spark, "export")
    tb.export_logs(audit_log(spark, d), path, "csv")
    return spark.read.schema(_LOG_COLUMNS.format("details string")).options(header="true", escape='"', **tb.EXPORT_TIMES).csv(path)


# --- SQL text -------------------------------------------------------------------------------


def _gold_views(spark, d):
    silver = silver_of(spark, d)
    gold.monthly_metrics(silver, key_is_unique=True).createOrReplaceTempView("gold_metricas_temporais")
    gold.state_profile(silver, key_is_unique=True).createOrReplaceTempView("gold_metricas_geograficas")


@query(
    "t4_run_capped",
    f"""{SILVER}, {MONTHLY} SELECT ano_mes, total_casos, true AS limitado, CAST(10 AS BIGINT) AS linhas, (SELECT count(*) FROM monthly_metrics) AS total
    FROM monthly_metrics ORDER BY ano_mes LIMIT 10""",
)
def t4(spark, d):
    _gold_views(spark, d)
    text = "SELECT ano_mes, total_casos FROM gold_metricas_temporais ORDER BY ano_mes LIMIT 1000"
    out = sqltool.run_capped(spark, text, max_rows=10, count_total=True)
    return out.rows.withColumns(
        {
            "limitado": F.lit(out.limited),
            "linhas": F.lit(out.n_rows).cast("bigint"),
            "total": F.lit(out.total_rows).cast("bigint"),
        }
    )


@query("t5_routed_newest", f"{SILVER}, {MONTHLY} SELECT * FROM monthly_metrics ORDER BY ano DESC, ano_mes DESC LIMIT 12")
def t5(spark, d):
    return sqltool.routed_rows(gold.monthly_metrics(silver_of(spark, d), key_is_unique=True), {"sg_uf": "NATION_3"}, ["ano", "ano_mes"])


@query("t5_routed_filtered", f"{SILVER}, {STATES} SELECT * FROM state_profile WHERE sg_uf = 'NATION_3'")
def t5_filtered(spark, d):
    return sqltool.routed_rows(gold.state_profile(silver_of(spark, d), key_is_unique=True), {"sg_uf": "NATION_3", "ano_mes": "1997-03"}, ["total_casos"])


@query("d2_sql_with_arguments", f"{SILVER}, {STATES} SELECT sg_uf, total_casos FROM state_profile WHERE total_casos > 480")
def d2(spark, d):
    _gold_views(spark, d)
    text = "SELECT sg_uf, total_casos FROM gold_metricas_geograficas WHERE total_casos > :minimo LIMIT 100"
    return sqltool.run_capped(spark, text, args={"minimo": 480}).rows


@query("v0_create_views", f"{SILVER}, {STATES} SELECT sg_uf, total_casos, taxa_mortalidade FROM state_profile WHERE taxa_mortalidade > 10")
def v0(spark, d):
    """The views over written gold tables, so a view does not recompute them."""
    silver = written_silver(spark, d)
    targets = {name: scratch_path(spark, name) for name in ("kpis", "months", "states")}
    tb.append_snapshot(gold.kpi_rows(gold.national_kpis(silver)), targets["kpis"], "2024-01-01")
    tb.write_table(gold.monthly_metrics(silver, key_is_unique=True), targets["months"])
    tb.write_table(gold.state_profile(silver, key_is_unique=True), targets["states"])
    views.create_views(*[tb.read_table(spark, path) for path in targets.values()])
    return spark.sql("SELECT sg_uf, total_casos, taxa_mortalidade FROM vw_alertas_mortalidade")


# --- streams --------------------------------------------------------------------------------


@query(
    "st1_sync_index",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN upper(source) ELSE source END AS source, md5(text) AS conteudo, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS versao FROM documents",
)
def st1(spark, d):
    source, target, state = scratch_path(spark, "drops"), scratch_path(spark, "index"), scratch_path(spark, "state")
    docs = table(spark, d, "documents").withColumn("versao", F.lit(1))
    docs.write.mode("append").parquet(source)
    index_sync.sync_index(spark, source, docs.schema, target, state)
    changed = docs.filter(F.col("lang") == "en").withColumns({"source": F.upper("source"), "versao": F.lit(2)})
    changed.write.mode("append").parquet(source)
    index_sync.sync_index(spark, source, docs.schema, target, state)
    return index_sync.current_index(spark, target).select("doc_id", "source", F.md5("text").alias("conteudo"), "versao")


def _event_stream(spark, d, clock=False):
    """The events in several files, the newest first, at most four files a micro-batch.

    `clock` adds a last row of no user, late enough for a watermark to pass all others.
    """
    events, path = table(spark, d, "events"), scratch_path(spark, "event-files")
    newest = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t")).first()["t"] or 0
    weeks = F.least(F.lit(3), ((F.lit(newest) - F.unix_micros(F.col("ts").cast("timestamp"))) / (8 * 86_400_000_000)).cast("int"))
    for week in range(4):
        events.filter(F.coalesce(weeks, F.lit(3)) == week).write.mode("append").parquet(path)
    if clock:
        tick = events.limit(1).withColumns(
            {"event_id": F.lit(-1).cast("bigint"), "user_id": F.lit(-1).cast(events.schema["user_id"].dataType),
             "ts": F.timestamp_micros(F.lit(newest + 90 * 86_400_000_000)).cast("timestamp_ntz")}
        )
        tick.write.mode("append").parquet(path)
    return file_stream(spark, path, events.schema, max_files=4)


@query("st2_rate_limit_stream", ORACLES["st2_rate_limit"])
def st2_stream(spark, d):
    target = scratch_path(spark, "verdicts")
    requests = _event_stream(spark, d, clock=True)
    stream = rate_limit_stream(requests, "user_id", "ts", "event_id", LIMIT_MINUTE, LIMIT_HOUR, delay="60 days")
    run_available(stream, target, scratch_path(spark, "state"), allow_late=False)
    return spark.read.parquet(target).filter("event_id >= 0").select("user_id", "event_id", "veredito")


@query("st4_append_events", f"{LOG} SELECT {OUT}, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date FROM log")
def st4_append(spark, d):
    target = scratch_path(spark, "events")
    audit_stream.append_events(as_audit_log(_event_stream(spark, d)), target, scratch_path(spark, "state"))
    return spark.read.parquet(target)


def _partials(spark, d):
    target = scratch_path(spark, "partials")
    audit_stream.run_partials(as_audit_log(_event_stream(spark, d)), target, scratch_path(spark, "state"))
    return audit_stream.current_partials(spark, target)


@query("st4_session_summary", ORACLES["a36_session_summary"])
def st4_sessions(spark, d):
    return audit_stream.session_summary(_partials(spark, d))


@query(
    "st4_error_trend",
    f"""{LOG} SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, event_type, count(*) AS error_count FROM log
    WHERE status IN ('error', 'critical') GROUP BY 1, 2""",
)
def st4_errors(spark, d):
    return audit_stream.error_trend(_partials(spark, d))
