"""Typing, bands, flags and rates on literal edge rows."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from episurv.functions.codes import AGE_BANDS, AGE_BANDS_COARSE, SEX_LABELS, SEX_UNKNOWN
from episurv.functions.columns import (
    age_years, band, flag, int_in_range, is_missing, ordinal, parse_date_multi, pct, rate, recode, share_filled, valid_only,
)


def values(df):
    return [r[0] for r in df.collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_dates_of_two_formats_never_raise(spark):
    texts = ["31/12/2024", "2024-12-31", "", None, "99/99/9999", "30/02/2024", "2024-13-01", "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    day = datetime.date(2024, 12, 31)
    assert values(df.select(parse_date_multi("d"))) == [day, day] + [None] * 6


def test_age_needs_the_unit_of_years_and_a_number(spark):
    rows = [("3", "0"), ("3", "120"), ("3", "121"), ("2", "11"), ("3", ""), ("3", "abc"), (None, "40"), ("3", None)]
    df = spark.createDataFrame(rows, "unit string, age string")
    assert values(df.select(age_years("age", "unit"))) == [0, 120, 121, None, None, None, None, None]


def test_int_in_range(spark):
    df = spark.createDataFrame([("1",), ("53",), ("54",), ("0",), ("x",), ("",), (None,)], "w string")
    assert values(df.select(int_in_range("w", 1, 53))) == [1, 53, None, None, None, None, None]


def test_recode_and_labels(spark):
    df = spark.createDataFrame([("M",), ("F",), ("I",), (None,)], "s string")
    assert values(df.select(recode("s", {"M": "1", "F": "2"}))) == ["1", "2", None, None]
    codes = spark.createDataFrame([("1",), ("2",), (None,)], "s string")
    assert values(codes.select(recode("s", SEX_LABELS, SEX_UNKNOWN))) == ["Masculino", "Feminino", "Não informado"]


def test_valid_only_keeps_the_two_answers(spark):
    df = spark.createDataFrame([("1",), ("2",), ("9",), ("",), (None,)], "c string")
    assert values(df.select(valid_only("c", ["1", "2"]))) == ["1", "2", None, None, None]


def test_flags_are_false_for_unknown(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "c string")
    assert values(df.select(flag("c", "1"))) == [True, False, False]


@pytest.mark.parametrize("age, label", [(0, "0-1 ano"), (1, "1-4 anos"), (4, "1-4 anos"), (5, "5-9 anos"), (17, "10-17 anos"),
                                        (18, "18-29 anos"), (69, "60-69 anos"), (70, "70+ anos"), (119, "70+ anos"), (None, "Desconhecido")])
def test_age_bands_are_left_closed(spark, age, label):
    assert one(spark, band(F.lit(age).cast("int"), AGE_BANDS)) == label


def test_every_age_falls_into_one_band_in_order(spark):
    labels = [label for _, label in AGE_BANDS]
    positions = values(spark.range(0, 121).select(ordinal(band(F.col("id"), AGE_BANDS), labels)).orderBy("id"))
    assert positions == sorted(positions) and set(positions) == set(range(1, 11))
    assert one(spark, ordinal(F.lit("Desconhecido"), labels)) == 99
    assert one(spark, band(F.lit(17), AGE_BANDS_COARSE)) == "0-17"


def test_rate_without_a_base_is_null_and_may_pass_100(spark):
    assert one(spark, rate(F.lit(1), F.lit(0))) is None
    assert one(spark, rate(F.lit(3), F.lit(2))) == 150.0
    assert one(spark, rate(F.lit(1), F.lit(3))) == 33.33
    assert one(spark, pct(F.lit(0), F.lit(0))) == 0.0


def test_rates_are_doubles(spark):
    assert dict(spark.range(1).select(rate(F.lit(1), F.lit(3)).alias("r")).dtypes) == {"r": "double"}


def test_missing_is_null_or_empty_but_not_blank(spark):
    df = spark.createDataFrame([("",), (None,), (" ",), ("x",)], "c string")
    assert values(df.select(is_missing("c"))) == [True, True, False, False]


def test_share_filled(spark):
    df = spark.createDataFrame([("a", 1, None, None)], "a string, b int, c string, d int")
    assert values(df.select(share_filled(["a", "b", "c", "d"]))) == [0.5]


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 10**6))
def test_rate_stays_in_range(spark, a, b):
    num, den = min(a, b), max(a, b)
    assert 0 <= one(spark, rate(F.lit(num), F.lit(den))) <= 100
