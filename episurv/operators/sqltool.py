"""SQL text from users: checked by the rules, arguments bound, result capped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from episurv.functions.documents import head_and_tail
from episurv.operators.filters import equality_filters
from episurv.operators.guard import sql_violation
from episurv.operators.rates import rows
from episurv.session import scratch_path

# Caps of results and of routed queries.
MAX_RESULT_ROWS, ROUTED_ROWS, NEWEST_ROWS, LOGGED_LENGTH = 10_000, 100, 12, 500


class QueryRefused(ValueError):
    """The text broke a rule."""


@dataclass(frozen=True)
class CappedResult:
    """At most `max_rows` rows of a result; `limited` tells whether there were more."""

    rows: DataFrame
    columns: list[str]
    n_rows: int
    limited: bool
    total_rows: int | None


def check_sql(spark: SparkSession, text: str) -> None:
    """Raise when the text breaks a rule."""
    verdict = spark.range(1).select(
        sql_violation(F.lit(text)).alias("v"), head_and_tail(F.lit(text), LOGGED_LENGTH).alias("q")
    ).first()
    if verdict.v is not None:
        raise QueryRefused(f"{verdict.v.violation_type}: {verdict.v.message} [{verdict.q}]")


def run_capped(
    spark: SparkSession,
    text: str,
    max_rows: int = MAX_RESULT_ROWS,
    args: Mapping[str, object] | None = None,
    count_total: bool = False,
    validate: bool = True,
) -> CappedResult:
    """Run a checked query once and keep at most `max_rows` rows, in its order.

    The result is written to the shared folder, and the write itself counts. Without a total, one row more than the cap tells
    whether it was hit, and the query may end there. With one, all rows are counted as they pass and each task keeps
    no more than the cap.
    """
    if validate:
        check_sql(spark, text)
    df = spark.sql(text, args=dict(args) if args else None)
    watch, path = Observation(), scratch_path(spark, "capped")
    place = "_" * (1 + max(map(len, df.columns))) + "place"
    source = df if count_total else df.limit(max_rows + 1)
    # The number of a row is that of its task, in the order of the result, and its place there in the lower 33 bits.
    placed = source.observe(watch, rows().alias("n")).withColumn(place, F.monotonically_increasing_id())
    first = placed.filter(F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) < max_rows)
    first.write.parquet(path)
    seen = int(watch.get["n"])
    kept = spark.read.schema(first.schema).parquet(path).orderBy(place).limit(max_rows).drop(place)
    return CappedResult(kept, df.columns, min(seen, max_rows), seen > max_rows, seen if count_total else None)


def routed_rows(
    table: DataFrame, filters: Mapping[str, str] | None, newest: Sequence[str], allowed: Sequence[str] = ("sg_uf", "ano_mes")
) -> DataFrame:
    """The rows a routed question gets: those of its filters, or the newest dozen.

    Filters on columns the table lacks are ignored. The sort columns are named, so months of a
    year do not tie.
    """
    mine = {k: v for k, v in (filters or {}).items() if k in table.columns}
    order = [F.desc(c) for c in newest]
    if mine:
        return equality_filters(table, mine, allowed).orderBy(*order).limit(ROUTED_ROWS)
    return table.orderBy(*order).limit(NEWEST_ROWS)
