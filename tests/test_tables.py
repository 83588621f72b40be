"""Sources, sinks, SQL text and streams, written to a fresh folder and read back."""

import datetime

import pytest
from pyspark.sql import functions as F

from episurv.operators import audit, sqltool, usage
from episurv.plans.audit_log import as_audit_log, audit_log
from episurv.plans.cases import raw_cases, table
from episurv.session import scratch_path, shared_dir
from episurv.sources import delimited as csv
from episurv.sources import tables as tb
from episurv.streaming import audit_stream, index_sync
from episurv.streaming.batches import file_stream, run_available
from episurv.streaming.rate_limit import rate_limit_stream

SF = "/root/testdata/sf0.001"


def test_delimited_text_survives(spark, tmp_path):
    body = 'NU;NOME;OBS\n1;"São ""Luís""";"a;b"\n2;José;"duas\nlinhas"\n3;;\n'
    (tmp_path / "INFLUD24-01.csv").write_bytes(body.encode("iso-8859-1"))
    (tmp_path / "INFLUD25-01.csv").write_bytes("NU;EXTRA\n4;x\n".encode("iso-8859-1"))
    df = csv.scan_year(spark, str(tmp_path), 2024)
    assert [f.dataType.simpleString() for f in df.schema] == ["string"] * 3
    rows = df.orderBy("NU").collect()
    assert (rows[0].NOME, rows[0].OBS) == ('São "Luís"', "a;b") and rows[1].OBS == "duas\nlinhas" and rows[2].NOME is None
    both = csv.ingest(spark, str(tmp_path), [2024, 2025])
    assert both.columns == ["NU", "NOME", "OBS", "ANO_DADOS", "_ingested_at", "_source_file", "EXTRA"]
    last = both.filter("NU = '4'").first()
    assert last.NOME is None and last.ANO_DADOS == 2025 and last._source_file.endswith("INFLUD25-01.csv")
    sources = {r.nome: r.bytes for r in csv.list_sources(spark, str(tmp_path)).collect()}
    assert sources["INFLUD25-01.csv"] == len("NU;EXTRA\n4;x\n") and len(sources) == 2
    report = {r.ano: (r.linhas, r.colunas, r.erro, r.total_linhas) for r in csv.dry_run(spark, str(tmp_path), [2024, 2025, 2026]).collect()}
    assert report == {2024: (3, 3, None, 4), 2025: (1, 2, None, 4), 2026: (0, 0, "PATH_NOT_FOUND", 4)}
    with pytest.raises(ValueError, match="2026"):
        csv.require_dry_run(csv.dry_run(spark, str(tmp_path), [2024, 2026]))


def test_no_source_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        csv.require_sources(csv.list_sources(spark, str(tmp_path)))


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named
    assert scratch_path(spark, "a").startswith(shared_dir(spark)) and scratch_path(spark, "a") != scratch_path(spark, "a")


class Unset:
    """A session without the setting."""

    def __init__(self, master):
        self.sparkContext, self.conf, self.master, self.folder = self, self, master, None

    def get(self, key, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_only_a_local_session_gets_its_own_folder():
    local = Unset("local[2]")
    assert shared_dir(local) == shared_dir(local) == local.folder
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Unset("yarn"))


def test_partitions_are_replaced_one_by_one(spark, scratch):
    target = f"{scratch}/t"
    df = spark.range(10).select("id", (F.col("id") % 2).alias("p"))
    tb.write_partitioned(df, target, ["p"])
    tb.write_partitioned(df.filter("p = 1").withColumn("id", F.col("id") * 100), target, ["p"])
    assert sorted(r.id for r in tb.read_table(spark, target).collect()) == [0, 2, 4, 6, 8, 100, 300, 500, 700, 900]
    tb.write_table(df.limit(1).drop("p"), target)
    assert tb.read_table(spark, target).columns == ["id"]


def test_clustered_files_hold_ranges(spark, scratch):
    target = f"{scratch}/c"
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("k"), (F.col("id") % 2).alias("p"))
    tb.cluster_layout(df, target, ["p"], ["k"], files=8)
    spans = tb.read_table(spark, target).groupBy(F.input_file_name()).agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n"))
    assert tb.read_table(spark, target).count() == 10_000
    assert spans.filter("b - a > 6000").count() == 0


def test_snapshots_and_ledger(spark, scratch):
    target, ledger = f"{scratch}/s", f"{scratch}/l"
    tb.append_snapshot(spark.range(2), target, "2024-01-01")
    tb.append_snapshot(spark.range(1).withColumn("novo", F.lit("x")), target, "2024-01-02")
    days = {r.data_snapshot: r.n for r in tb.read_snapshots(spark, target).groupBy("data_snapshot").agg(F.count("novo").alias("n")).collect()}
    assert days == {datetime.date(2024, 1, 1): 0, datetime.date(2024, 1, 2): 1}
    assert tb.write_with_ledger(spark.range(5), f"{scratch}/a", ledger, "A") == 5
    tb.write_with_ledger(spark.range(3), f"{scratch}/b", ledger, "B")
    assert [(r.version, r.operation, r.num_rows) for r in tb.read_ledger(spark, ledger).orderBy("version").collect()] == [(0, "A", 5), (1, "B", 3)]


def test_sql_is_checked_and_capped(spark):
    spark.range(50).createOrReplaceTempView("gold_resumo_geral")
    text = "SELECT id FROM gold_resumo_geral WHERE id >= :low LIMIT 1000"
    capped = sqltool.run_capped(spark, text, max_rows=10, args={"low": 5}, count_total=True)
    assert (capped.n_rows, capped.limited, capped.total_rows, capped.columns) == (10, True, 45, ["id"])
    exact = sqltool.run_capped(spark, text, max_rows=45, args={"low": 5})
    assert (exact.n_rows, exact.limited, exact.total_rows) == (45, False, None)
    with pytest.raises(sqltool.QueryRefused, match="FORBIDDEN_COMMAND"):
        sqltool.run_capped(spark, "DELETE FROM gold_resumo_geral")


def test_bound_arguments_are_data(spark):
    spark.createDataFrame([("a",)], "s string").createOrReplaceTempView("gold_resumo_geral")
    text = "SELECT * FROM gold_resumo_geral WHERE s = :s LIMIT 10"
    assert sqltool.run_capped(spark, text, args={"s": "a' OR '1'='1"}).n_rows == 0


def test_index_sync_is_incremental_and_repeatable(spark, scratch):
    source, target, state = f"{scratch}/src", f"{scratch}/idx", f"{scratch}/cp"
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(source)
    index_sync.sync_index(spark, source, schema, target, state)
    index_sync.sync_index(spark, source, schema, target, state)
    spark.createDataFrame([(2, "B"), (3, "c")], schema).write.mode("append").parquet(source)
    index_sync.sync_index(spark, source, schema, target, state)
    now = {r.doc_id: r.text for r in index_sync.current_index(spark, target).collect()}
    assert now == {1: "a", 2: "B", 3: "c"}
    assert spark.read.parquet(target).count() == 4
    index_sync.compact(spark, target, f"{scratch}/compact")
    assert {r.doc_id: r.text for r in index_sync.current_index(spark, f"{scratch}/compact").collect()} == now


def weekly_files(events, source, order):
    """The events of each week as a file, written in the given order."""
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    for n in order:
        events.filter(week == n).coalesce(1).write.mode("append").parquet(source)


def clock_row(events, source):
    later = F.lit("2024-06-01").cast("timestamp_ntz")
    events.limit(1).withColumns({"event_id": F.lit(-1).cast("bigint"), "event_type": F.lit("clock"), "ts": later}).write.mode("append").parquet(source)


@pytest.mark.parametrize("order,delay", [((0, 1, 2, 3, 4), "1 day"), ((4, 3, 2, 1, 0), "40 days"), ((1, 0, 3, 2, 4), "15 days")])
def test_stream_limiter_equals_batch_over_several_batches(spark, scratch, order, delay):
    events = table(spark, SF, "events")
    source, target = f"{scratch}/src", f"{scratch}/out"
    weekly_files(events, source, order)
    clock_row(events, source)
    stream = rate_limit_stream(file_stream(spark, source, events.schema, max_files=1), "event_type", "ts", "event_id", 1, 2, delay)
    run_available(stream, target, f"{scratch}/cp", allow_late=False)
    streamed = {r.event_id: r.veredito for r in spark.read.parquet(target).collect() if r.event_id >= 0}
    batch = {r.event_id: r.veredito for r in usage.rate_limit(events, "event_type", "ts", "event_id", 1, 2).collect()}
    assert streamed == batch and "negado_hora" in batch.values()


def test_requests_later_than_the_delay_are_reported(spark, scratch):
    events = table(spark, SF, "events")
    weekly_files(events, f"{scratch}/src", (4, 3, 2, 1, 0))
    stream = rate_limit_stream(file_stream(spark, f"{scratch}/src", events.schema, max_files=1), "event_type", "ts", "event_id", 1, 2, "1 hour")
    with pytest.raises(ValueError, match="later than the watermark"):
        run_available(stream, f"{scratch}/out", f"{scratch}/cp", allow_late=False)


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4), (4, 3, 2, 1, 0)])
def test_stream_summaries_equal_batch(spark, scratch, order):
    events = table(spark, SF, "events")
    weekly_files(events, f"{scratch}/src", order)
    log = as_audit_log(file_stream(spark, f"{scratch}/src", events.schema, max_files=1))
    audit_stream.run_partials(log, f"{scratch}/p", f"{scratch}/cp")
    partials = audit_stream.current_partials(spark, f"{scratch}/p")
    assert partials.agg(F.sum("_n")).first()[0] == events.count()
    got = audit_stream.session_summary(partials).withColumn("start_time", F.col("start_time").cast("string")).drop("end_time")
    want = audit.session_summary(audit_log(spark, SF)).withColumn("start_time", F.col("start_time").cast("string")).drop("end_time")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    trend = {(r.date, r.event_type): r.error_count for r in audit_stream.error_trend(partials).collect()}
    assert trend == {(r.date, r.event_type): r.error_count for r in audit.error_trend(audit_log(spark, SF), 60, "2024-01-31").collect()}


def test_log_queries(spark):
    log = audit_log(spark, SF)
    assert audit.query_logs(log).count() == log.count()
    first = log.orderBy("timestamp").first()
    exact = audit.query_logs(log, start=str(first.timestamp), end=str(first.timestamp))
    assert exact.count() == 1
    assert audit.errors(log).filter("status NOT IN ('error', 'critical')").count() == 0


def test_raw_records_round_trip(spark, scratch):
    raw = raw_cases(spark, SF)
    tb.write_table(raw, f"{scratch}/raw")
    assert tb.read_table(spark, f"{scratch}/raw").exceptAll(raw).count() == 0


def test_single_files_without_a_shuffle_of_years(spark, monkeypatch):
    """A year of one file is not gathered and sorted in a task's memory."""
    from pyspark.sql import DataFrame

    from episurv.registry import io_queries

    dealt = []
    for kind in {DataFrame, *type(spark.range(1)).__mro__} - {object}:
        if "repartition" in vars(kind):
            monkeypatch.setattr(kind, "repartition", lambda df, *by, f=vars(kind)["repartition"]: dealt.append(by) or f(df, *by))
    d = "/root/testdata/sf0.001"
    one, four = (spark.read.options(header="true", sep=";").csv(io_queries._csv_folder(spark, d, parts)) for parts in (1, 4))
    assert len(dealt) == 1
    assert sorted(map(str, one.collect())) == sorted(map(str, four.select(one.columns).collect()))
    assert len(one.inputFiles()) == one.select("src").distinct().count()
