"""Layouts skip what they say they skip; capped SQL and gates run their input once."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from episurv.functions import semistructured as semi
from episurv.operators import quality as q
from episurv.operators import sqltool
from episurv.plans.cases import raw_cases
from episurv.plans.silver import silver_cases
from episurv.sources import layout
from episurv.sources.tables import cluster_layout
from episurv.streaming.batches import file_stream, run_available
from episurv.streaming.windows import closed_windows, error_windows

SF = "/root/testdata/sf0.001"


def test_morton_code_interleaves_bits(spark):
    rows = spark.range(64).select((F.col("id") % 8).cast("int").alias("x"), (F.col("id") / 8).cast("int").alias("y"))
    got = {(r.x, r.y): r.z for r in rows.withColumn("z", layout.morton_code([F.col("x"), F.col("y")], 3)).collect()}
    for (x, y), z in got.items():
        bits = "".join(a + b for a, b in zip(f"{x:03b}", f"{y:03b}"))
        assert z == int(bits, 2)


@pytest.mark.parametrize("bounds", [[], [5], [1, 2, 3], list(range(0, 40, 3))])
def test_range_number(spark, bounds):
    df = spark.range(-2, 50).select(F.col("id").cast("int").alias("x")).union(spark.sql("SELECT CAST(NULL AS INT)"))
    got = [(r.x, r.n) for r in df.withColumn("n", layout.range_number("x", bounds)).collect()]
    assert all(n == (0 if x is None else sum(b <= x for b in bounds)) for x, n in got)


def footers(target, key):
    out = []
    import glob

    for path in glob.glob(f"{target}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(path).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        stats = [meta.row_group(g).column(names.index(key)).statistics for g in range(meta.num_row_groups)]
        out.append((min(s.min for s in stats), max(s.max for s in stats)))
    return out


def test_morton_files_are_skipped_by_either_key(spark, scratch):
    rng = random.Random(1)
    rows = [(i, rng.randrange(1000), f"s{rng.randrange(30):02}", "p") for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, day int, state string, part string")
    layout.morton_layout(df, f"{scratch}/morton", ["part"], ["day", "state"], files=16)
    cluster_layout(df, f"{scratch}/linear", ["part"], ["day", "state"], files=16)

    def read(target, key, value):
        files = footers(f"{scratch}/{target}", key)
        return sum(lo <= value <= hi for lo, hi in files) / len(files)

    def mean(target, key, values):
        return sum(read(target, key, v) for v in values) / len(values)

    states = [f"s{i:02}" for i in range(30)]
    assert mean("linear", "state", states) > 0.9  # the order by day leaves every file with every state
    assert mean("morton", "state", states) < 0.5
    assert mean("morton", "day", range(0, 1000, 50)) < 0.5
    assert spark.read.parquet(f"{scratch}/morton").count() == 6000
    ranges = layout.file_ranges(spark, f"{scratch}/morton", ["day", "state"]).collect()
    assert sorted((r.min_state, r.max_state) for r in ranges) == sorted(footers(f"{scratch}/morton", "state"))


def test_morton_of_odd_tables(spark, scratch):
    df = spark.createDataFrame([(1, None, None, "p"), (2, None, "a", "p")], "id long, day int, state string, part string")
    layout.morton_layout(df, f"{scratch}/nulls", ["part"], ["day", "state"])
    assert spark.read.parquet(f"{scratch}/nulls").count() == 2
    layout.morton_layout(df.limit(0), f"{scratch}/none", ["part"], ["day", "state"])


def scanned_rows(df):
    """Rows that came out of the scans of a query that has run."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if "FileSourceScanExec" in node.getClass().getSimpleName():
            total += node.metrics().apply("numOutputRows").value()
    return total


def test_bloom_filters_skip_row_groups(spark, scratch):
    ids = [f"session-{random.Random(i).random()}" for i in range(4000)]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "session_id string, event_id long").repartition(8)
    layout.write_lookup_log(df, f"{scratch}/log", {"session_id": 1000})
    df.write.parquet(f"{scratch}/plain")
    found = layout.find_rows(spark, f"{scratch}/log", "session_id", [ids[7]])
    plain = layout.find_rows(spark, f"{scratch}/plain", "session_id", [ids[7]])
    assert [r.event_id for r in found.collect()] == [7] == [r.event_id for r in plain.collect()]
    # The ids' ranges overlap in all files; only the filters tell them apart. The first collect has filled the metrics.
    assert scanned_rows(found) < 2000 < 3000 < scanned_rows(plain)


def test_bucketed_tables_join_without_exchange(spark, scratch):
    left = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("a"))
    right = spark.range(0, 500, 3).select(F.col("id").alias("doc_id"), F.lit("y").alias("b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        layout.write_bucketed(left, "bucketed_left", f"{scratch}/left", "doc_id", 4)
        layout.write_bucketed(right, "bucketed_right", f"{scratch}/right", "doc_id", 4)
        joined = spark.table("bucketed_left").join(spark.table("bucketed_right"), "doc_id")
        assert joined.count() == 167
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("bucketed_left", "bucketed_right"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.mark.parametrize("cap,total", [(3, True), (3, False), (100, True), (100, False), (10, True)])
def test_capped_text_runs_once(spark, cap, total):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    spark.range(0, 10, 1, 3).mapInArrow(count, "id long").createOrReplaceTempView("counted_once")
    out = sqltool.run_capped(spark, "SELECT id FROM counted_once", cap, count_total=total, validate=False)
    assert [r.id for r in out.rows.collect()] == list(range(min(cap, 10)))
    assert out.n_rows == min(cap, 10) and out.limited == (cap < 10) and out.total_rows == (10 if total else None)
    assert runs.value <= 10 and (not total or runs.value == 10)


def test_capped_text_keeps_its_order(spark):
    spark.range(1000).createOrReplaceTempView("ordered_once")
    out = sqltool.run_capped(spark, "SELECT id FROM ordered_once ORDER BY id % 7, id DESC", 5, count_total=True, validate=False)
    assert [r.id for r in out.rows.collect()] == [994, 987, 980, 973, 966] and out.total_rows == 1000


def test_gates_of_the_write_read_raw_once(spark, scratch):
    raw, seen = raw_cases(spark, SF), spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    total = raw.count()
    written = q.write_through_gates(raw.mapInArrow(count, raw.schema), silver_cases, f"{scratch}/silver")
    assert seen.value == total
    want = q.load_gates(raw, spark.read.parquet(f"{scratch}/silver"))
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, want.collect()))


def test_variant_details(spark):
    texts = ['{"a": {"b": [1, "x"]}}', '{"a": 3}', "{", "", None, "[]", "7"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = semi.with_details(df, "text").select("id", semi.detail("details", "$.a.b[1]").alias("b"), semi.detail("details", "$.a", "int").alias("a"), "malformed")
    got = {r.id: (r.b, r.a, r.malformed) for r in rows.collect()}
    assert got == {0: ("x", None, None), 1: (None, 3, None), 2: (None, None, "{"), 3: (None, None, ""), 4: (None,) * 3, 5: (None,) * 3, 6: (None,) * 3}
    kinds = semi.detail_kinds(semi.with_details(df, "text"), "details").collect()
    assert sum(r.rows for r in kinds) == len(texts)


def test_windows_report_late_events(spark, scratch):
    from test_limiter_stream import write

    batches = [[("error", 1, 0), ("view", 2, 10)], [("error", 3, 90_000)], [("error", 4, 200_000)], [("error", 5, 300_000)], [("error", 6, 20)], [("view", 7, 2_000_000)]]
    write(spark, f"{scratch}/src", batches)
    schema = "k string, n long, ts timestamp"

    def run(delay, name):
        log = file_stream(spark, f"{scratch}/src", schema, max_files=1).select(F.col("ts").alias("timestamp"), F.col("k").alias("event_type"), F.col("k").alias("status"))
        run_available(error_windows(log, delay), f"{scratch}/{name}", f"{scratch}/{name}-state", allow_late=False)
        return {str(r.date): r.error_count for r in closed_windows(spark.read.parquet(f"{scratch}/{name}")).collect()}

    assert run("7 days", "patient") == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 1, "2024-01-04": 1}
    with pytest.raises(ValueError, match="1 rows came later"):
        run("1 hour", "hasty")
