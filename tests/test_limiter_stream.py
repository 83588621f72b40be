"""The limiter's stream over many micro-batches, and state that goes when it is over."""

import datetime as dt

import pandas as pd
import pytest

from episurv.operators import usage
from episurv.streaming.batches import file_stream, run_available
from episurv.streaming import rate_limit
from episurv.streaming.rate_limit import rate_limit_stream

SCHEMA = "k string, n long, ts timestamp"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def write(spark, folder, batches):
    """Each batch as one file, with increasing times of change."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(folder)
    for i, rows in enumerate(batches):
        table = pa.table(
            {
                "k": pa.array([r[0] for r in rows], pa.string()),
                "n": pa.array([r[1] for r in rows], pa.int64()),
                "ts": pa.array([START + dt.timedelta(seconds=r[2]) for r in rows], pa.timestamp("us", "UTC")),
            }
        )
        pq.write_table(table, f"{folder}/{i:04}.parquet")
        os.utime(f"{folder}/{i:04}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def test_an_early_late_row_is_reported_after_100_batches(spark, scratch):
    """The engine remembers the progress of its last 100 batches only."""
    batches = [[("a", i, 7200 * i)] for i in range(103)]
    batches[5].append(("a", 1000, 0))  # hours behind the watermark, which allows one minute
    write(spark, f"{scratch}/src", batches)
    stream = rate_limit_stream(file_stream(spark, f"{scratch}/src", SCHEMA, max_files=1), "k", "ts", "n", 1, 2, "1 minute")
    with pytest.raises(ValueError, match="1 rows came later"):
        run_available(stream, f"{scratch}/out", f"{scratch}/cp", allow_late=False)


def test_out_of_order_within_the_delay_equals_batch(spark, scratch):
    rows = [("a", i, 11 * i) for i in range(60)] + [("b", 100 + i, 1800 * i) for i in range(8)] + [("a", 200 + i, 90_000 + i) for i in range(5)]
    batches = [rows[j::7][::-1] for j in range(7)] + [[("clock", -1, 400_000)], [("clock", -2, 500_000)]]
    write(spark, f"{scratch}/src", batches)
    source = file_stream(spark, f"{scratch}/src", SCHEMA, max_files=1)
    run_available(rate_limit_stream(source, "k", "ts", "n", 3, 12, "2 days"), f"{scratch}/out", f"{scratch}/cp", allow_late=False)
    got = {r.n: r.veredito for r in spark.read.parquet(f"{scratch}/out").collect() if r.n >= 0}
    df = spark.read.schema(SCHEMA).parquet(f"{scratch}/src").filter("n >= 0")
    want = {r.n: r.veredito for r in usage.rate_limit(df, "k", "ts", "n", 3, 12).collect()}
    assert got == want and set(want.values()) == {"permitido", "negado_minuto", "negado_hora"}
    left = spark.read.format("statestore").option("path", f"{scratch}/cp").option("stateVarName", "admitted").option("flattenCollectionTypes", True).load()
    assert {r["key"]["k"] for r in left.select("key").distinct().collect()} <= {"clock"}  # an hour of silence clears a key


@pytest.mark.parametrize("few", [0, 3, 1024])
def test_lists_and_pieces_equal_batch(spark, scratch, monkeypatch, few):
    """Keys that change from a list to minutes and back, while the watermark moves on."""
    monkeypatch.setattr(rate_limit, "FEW", few)
    rows = [("a", i, 97 * i) for i in range(90)] + [("b", 100 + i, 1500 * i) for i in range(6)] + [("a", 200 + i, 30_000 + 9 * i) for i in range(20)]
    rows = sorted(rows, key=lambda r: r[2])
    batches = [rows[j : j + 15][::-1] for j in range(0, len(rows), 15)] + [[("clock", -1, 60_000)], [("clock", -2, 90_000)]]
    write(spark, f"{scratch}/src", batches)
    source = file_stream(spark, f"{scratch}/src", SCHEMA, max_files=1)
    run_available(rate_limit_stream(source, "k", "ts", "n", 1, 5, "10 minutes"), f"{scratch}/out", f"{scratch}/cp", allow_late=False)
    got = {r.n: r.veredito for r in spark.read.parquet(f"{scratch}/out").collect() if r.n >= 0}
    df = spark.read.schema(SCHEMA).parquet(f"{scratch}/src").filter("n >= 0")
    assert got == {r.n: r.veredito for r in usage.rate_limit(df, "k", "ts", "n", 1, 5).collect()}


def test_calls_of_the_store_do_not_grow_with_requests():
    """Requests that wait are judged at one timer, with a number of calls that their number has no part in."""

    class Store:
        def __init__(self, calls):
            self.calls, self.value = calls, None

        def __getattr__(self, name):
            def call(*args):
                self.calls.append(name)
                if name in ("update", "put"):
                    self.value = args[0]
                return {"exists": self.value is not None, "get": self.value, "containsKey": False}.get(name)

            return call

    class Handle(Store):
        def __getattr__(self, name):
            return (lambda *_: Store(self.calls)) if name.endswith("State") else super().__getattr__(name)

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    calls = []
    limiter = rate_limit.Limiter("k", "n", "bigint", 1, 1)
    limiter.init(Handle(calls))
    at = [i * 7_200_000_000 for i in range(500)]
    limiter.handleInputRows(("a",), iter([pd.DataFrame({"request_micros": at, "n": range(500)})]), None)
    out = list(limiter.handleExpiredTimer(("a",), At(10**10), At(60_000)))
    assert [len(x) for x in out] == [500] and len(calls) < 20
