"""One key with most of the rows: same results, bounded groups."""

import re

from pyspark.sql import functions as F

from episurv.operators import audit, usage
from episurv.operators.association import association_matrix
from episurv.operators.dialogue import exchanges, with_history
from episurv.operators.filters import first_per_key
from episurv.operators.textrules import dedupe_by_content
from episurv.plans import gold
from episurv.plans.cases import raw_cases
from episurv.plans.silver import silver_cases

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_thinned_out_before_the_shuffle(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    kept = first_per_key(df, "k", ["id"])
    text = plan(kept)
    assert text.index("Final") < text.index("Partial")
    assert text.count("WindowGroupLimit") == 2
    assert kept.filter("k = 0").first().id == 0
    assert kept.count() == df.select("k").distinct().count()


def test_copies_of_one_text(spark):
    df = spark.range(9_000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    kept = dedupe_by_content(df, ["text"], ["id"])
    assert kept.count() == 6_001 and kept.filter("text = 'same'").first().id == 0


def test_a_hot_key_is_counted_by_slices(spark):
    n = 20_000
    rows = spark.range(n).select((F.col("id") % 1).alias("k"), F.col("id").alias("n"), F.timestamp_micros(F.col("id") * 100_000).alias("ts"))
    load = usage.offered_load(rows, "k", "ts", "n")
    got = {r.n: (r.no_ultimo_minuto, r.na_ultima_hora) for r in load.filter("n IN (0, 599, 600, 19999)").collect()}
    assert got == {0: (1, 1), 599: (600, 600), 600: (600, 601), 19999: (600, 20000)}
    assert re.search(r"Exchange hashpartitioning\(k#\d+L, _slice#\d+L", plan(load))


def test_a_long_conversation_is_numbered_by_blocks(spark):
    n = 6_000
    rows = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"),
    )
    pairs = exchanges(rows, block=256)
    assert pairs.filter(F.col("anteriores") != F.col("turn") / 2).count() == 0
    last = with_history(rows).orderBy(F.desc("turn")).first()
    assert last.lembrados == 3 and last.contexto.startswith("Histórico recente:\nP: 5992\nR: 5993...")


def test_a_hot_session_is_counted_before_it_is_gathered(spark):
    log = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("session_id"),
        F.timestamp_seconds("id").alias("timestamp"), F.lit("x").alias("event_type"), F.lit("error").alias("status"),
        F.lit(1.0).alias("elapsed_seconds"),
    )
    hot = audit.session_summary(log).filter("session_id = 'hot'").first()
    assert (hot.total_events, hot.error_count, hot.events_by_type) == (20_000, 20_000, {"x": 20_000})


def test_windows_without_a_key_see_aggregates_only(spark):
    silver = silver_cases(raw_cases(spark, SF))
    for table in (gold.monthly_metrics(silver, key_is_unique=True), gold.state_profile(silver, key_is_unique=True), gold.series_table(silver)):
        lines = plan(table).splitlines()
        single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
        assert all("HashAggregate" in "".join(lines[i + 1 : i + 8]) for i in single)


def test_the_matrix_is_built_from_code_vectors(spark):
    raw = raw_cases(spark, SF)
    lines = plan(association_matrix(raw)).splitlines()
    pairs = next(i for i, line in enumerate(lines) if "Generate inline" in line)
    assert "HashAggregate" in lines[pairs + 1] or "HashAggregate" in lines[pairs + 2]


def test_no_plan_multiplies_rows_by_rows():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "episurv"
    text = "".join(p.read_text() for p in root.rglob("*.py") if "registry" not in p.parts)
    assert not re.search(r"crossJoin|localCheckpoint|broadcast\(|toPandas|\.rdd\b|\.cache\(|\.persist\(", text)
