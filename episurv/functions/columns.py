"""Column expressions shared by the operators. All are built-in Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from episurv.functions.codes import AGE_UNIT_YEARS, DATE_FORMATS, UNKNOWN_BAND


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# --- typing ---------------------------------------------------------------------------------


def _digits_date(text: Column, fmt: str) -> Column:
    """A date of fixed digit positions, or NULL.

    The shape is compared first, then the digits are put in ISO order for a plain cast. A parser
    with a pattern signals each text it cannot read by an exception, which costs more than the
    rest of the row where formats are mixed.
    """
    shape = "".join("0" if ch in "dMy" else ch for ch in fmt)

    def part(token: str) -> Column:
        return F.substring(text, fmt.index(token) + 1, len(token))

    iso = F.concat(part("yyyy"), F.lit("-"), part("MM"), F.lit("-"), part("dd"))
    fits = (F.translate(text, "123456789", "000000000") == shape) & (part("yyyy") != "0000")
    return F.when(fits, iso.try_cast("date"))


def parse_date_multi(c: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that parses, else NULL; never raises, also under ANSI."""
    text = as_col(c)
    return F.coalesce(
        *[
            _digits_date(text, f) if sorted(re.findall("[a-zA-Z]+", f)) == ["MM", "dd", "yyyy"] else F.try_to_date(text, f)
            for f in formats
        ]
    )


def try_int(c: str | Column) -> Column:
    return as_col(c).try_cast("int")


def age_years(value: str | Column, unit: str | Column) -> Column:
    """Age when the unit says years, else NULL."""
    return F.when(as_col(unit) == AGE_UNIT_YEARS, try_int(value))


def int_in_range(c: str | Column, low: int, high: int) -> Column:
    number = try_int(c)
    return F.when(number.between(low, high), number)


def recode(c: str | Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Map listed codes, everything else (and NULL) to the default."""
    out = F.lit(default).cast("string")
    for code, label in reversed(list(mapping.items())):
        out = F.when(as_col(c) == code, F.lit(label)).otherwise(out)
    return out


def valid_only(c: str | Column, codes: Sequence[str]) -> Column:
    return F.when(as_col(c).isin(*codes), as_col(c))


def flag(c: str | Column, value: str) -> Column:
    """True on the value, false for anything else, unknown included."""
    return F.coalesce(as_col(c) == value, F.lit(False))


# --- derived --------------------------------------------------------------------------------


def year_month(c: str | Column) -> Column:
    return F.concat(
        F.year(as_col(c)).cast("string"), F.lit("-"), F.lpad(F.month(as_col(c)).cast("string"), 2, "0")
    )


def band(c: str | Column, cuts: Sequence[tuple[int | None, str]], unknown: str = UNKNOWN_BAND) -> Column:
    """Left-closed bands from a cut-point list; NULL goes to the unknown label."""
    out = F.lit(unknown)
    for upper, label in reversed(cuts):
        test = as_col(c).isNotNull() if upper is None else as_col(c) < upper
        out = F.when(test, F.lit(label)).otherwise(out)
    return out


def ordinal(c: str | Column, labels: Sequence[str], other: int = 99) -> Column:
    """Position of a label in a list, from 1."""
    out = F.lit(other)
    for position, label in reversed(list(enumerate(labels, 1))):
        out = F.when(as_col(c) == label, F.lit(position)).otherwise(out)
    return out


def share_filled(cols: Sequence[str | Column]) -> Column:
    """Share of the columns that are not NULL, 0..1."""
    filled = [as_col(c).isNotNull().cast("int") for c in cols]
    return reduce(lambda a, b: a + b, filled) / F.lit(float(len(filled)))


def is_missing(c: str | Column) -> Column:
    """NULL or the empty string."""
    return as_col(c).isNull() | (as_col(c) == "")


# --- rates ----------------------------------------------------------------------------------


def rate(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """Percentage in double arithmetic; NULL when the denominator is zero or NULL."""
    return F.round(F.try_divide(numerator * F.lit(100.0), denominator.cast("double")), digits)


def pct(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """Percentage computed as a ratio first, 0 for an empty base."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double")) * F.lit(100.0)
    return F.round(F.coalesce(ratio, F.lit(0.0)), digits)


def thresholds(value: Column, steps: Sequence[tuple[Column, str]], last: str) -> Column:
    """First matching label of (condition, label) pairs."""
    out = F.lit(last)
    for condition, label in reversed(list(steps)):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)
