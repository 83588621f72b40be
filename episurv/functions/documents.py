"""Text formats and metadata expressions of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from episurv.functions.columns import as_col


def parse_metadata(c: str | Column) -> Column:
    """JSON object as a map; an empty map for NULL or broken text."""
    parsed = F.from_json(as_col(c), "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def thousands(c: str | Column) -> Column:
    """1,234,567"""
    return F.format_string("%,d", as_col(c).cast("bigint"))


def fixed(c: str | Column, digits: int = 2, signed: bool = False, missing: str = "N/A") -> Column:
    """Fixed number of digits, rounded half up first; a missing value has a text of its own."""
    shape = f"%{'+' if signed else ''}.{digits}f"
    return F.when(as_col(c).isNull(), F.lit(missing)).otherwise(
        F.format_string(shape, F.round(as_col(c).cast("double"), digits))
    )


def head_and_tail(c: str | Column, max_length: int = 500) -> Column:
    """Long text as its head and tail around a marker with the full length."""
    text = as_col(c)
    half = (max_length - 20) // 2
    short = F.concat(
        F.substring(text, 1, half), F.lit(" ... [TRUNCADO "), F.length(text).cast("string"), F.lit(" chars] ... "),
        F.right(text, F.lit(half)),
    )
    return F.when(F.length(text) <= max_length, text).otherwise(short)


def content_hash(*parts: str | Column) -> Column:
    return F.md5(F.lower(F.concat(*[F.coalesce(as_col(p), F.lit("")) for p in parts])))
