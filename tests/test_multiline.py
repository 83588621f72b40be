"""Records over several lines, read in splits: the same rows as Spark's own reader, one file a task."""

import random

import pytest
from pyspark.errors import PySparkException

from episurv.sources.delimited import ingest, scan_delimited
from episurv.sources.multiline import ingest_records, scan_records

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, "97")
    yield spark
    spark.conf.set(SPLIT, before)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def field(rng):
    kind = rng.random()
    text = "".join(rng.choice("ab; \né\"") for _ in range(rng.randrange(9)))
    if kind < 0.5:
        return '"' + text.replace('"', '""') + '"'
    if kind < 0.6:
        return 'x"' + text.translate(str.maketrans("", "", ";\n"))  # quotes inside a field without quotes are text
    if kind < 0.65:
        return '"a"b'  # text behind a closing quote
    return text.translate(str.maketrans("", "", ";\n\""))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_rows_as_whole_files(small_splits, tmp_path, end):
    rng = random.Random(7)
    for n in range(3):
        records = ['"first\nname";second;third'] + [";".join(field(rng) for _ in range(rng.choice([3, 3, 3, 2]))) for _ in range(150)]
        body = ("\n" * n + "\n".join(records) + "\n" * (n % 2)).replace("\n", end)
        (tmp_path / f"{n}.csv").write_bytes(body.encode("iso-8859-1"))
    path = str(tmp_path / "*.csv")
    want, got = scan_delimited(small_splits, path), scan_records(small_splits, path)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_one_record_over_many_splits(small_splits, tmp_path):
    long = "\n".join(f"line {k}" for k in range(200))
    (tmp_path / "a.csv").write_text(f'n;text\n1;"{long}"\n2;b\n3;"{long}";\n\n4;"c\nd"')
    got = scan_records(small_splits, str(tmp_path / "a.csv"), source_col="src").collect()
    assert {(r.n, r.text) for r in got} == {("1", long), ("2", "b"), ("3", long), ("4", "c\nd")}
    assert all(r.src.endswith("a.csv") for r in got)


def test_a_quote_without_end_is_an_error(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('n;text\n1;"' + "never closed\n" * 200)
    with pytest.raises(PySparkException, match="record without an end"):
        scan_records(small_splits, str(tmp_path / "a.csv"), ["n", "text"], most_bytes=500).collect()


def test_headers_empty_files_and_options(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"n;x\n")
    (tmp_path / "b.csv").write_bytes(b"")
    (tmp_path / "c.csv").write_bytes('n;x\n1;"é\n2"\n1;"é\n2"\n;\n""\n'.encode())
    path = str(tmp_path / "*.csv")
    got = scan_records(spark, path, ["n", "x"], encoding="UTF-8")
    assert rows(got) == rows(scan_delimited(spark, path, ["n", "x"], encoding="UTF-8")) and got.count() == 4
    bare = scan_records(spark, path, ["n", "x"], encoding="UTF-8", header="false")
    assert bare.count() == 6
    with pytest.raises(ValueError):
        scan_records(spark, path, ["n"], escape="\\")


def test_texts_move_once_to_their_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n;x\n1;"a\nb"\n2;c\n')
    df = scan_records(spark, str(tmp_path / "a.csv"))
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text and "SinglePartition" not in text and "ArrowEval" not in text


def test_ingest_of_years(small_splits, tmp_path):
    (tmp_path / "INFLUD24-1.csv").write_text('NU;T\n1;"a\n;b"\n2;c\n' + '3;"d\n\ne"\n' * 30)
    (tmp_path / "INFLUD25-1.csv").write_text("NU;X\n4;x\n")
    want, got = (f(small_splits, str(tmp_path), [2024, 2025]).drop("_ingested_at") for f in (ingest, ingest_records))
    assert set(got.columns) == set(want.columns) and rows(got.select(want.columns)) == rows(want)
