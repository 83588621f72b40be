"""Every registered query next to its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, scratch, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        verdict, _ = compare(df, ORACLES[name], con)
        assert verdict == "ok"
    else:
        assert df.count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
