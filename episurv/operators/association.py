"""Association of categorical codes: contingency tables and Cramér's V."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episurv.functions.codes import ASSOCIATION_FIELDS, IGNORED

# Reading of V.
REPORTED_V, STRONG_V = 0.20, 0.40


def contingency(df: DataFrame, var1: str, var2: str, exclude: Sequence[str] = (IGNORED,)) -> DataFrame:
    """Counts of each pair of codes, in long form; NULL and excluded codes are left out."""
    a, b = F.col(var1), F.col(var2)
    kept = df.filter(a.isNotNull() & b.isNotNull())
    for code in exclude:
        kept = kept.filter((a.cast("string") != code) & (b.cast("string") != code))
    return kept.groupBy(a.alias("valor1"), b.alias("valor2")).agg(F.count(F.lit(1)).alias("casos"))


def cramers_v_of_cells(cells: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Cramér's V from long contingency cells (valor1, valor2, casos), per group of `by`.

    Absent cells need not be filled in: without correction chi² is n(Σ o²/(r·c) − 1), where a zero
    cell adds nothing. In a 2x2 table |o − e| is the same in all four cells, so the continuity
    correction needs the margins and one cell only: (d − min(½, d))²·n·Σ1/r·Σ1/c.
    """
    row, col = [*by, "valor1"], [*by, "valor2"]
    known = F.col("valor1").isNotNull() & F.col("valor2").isNotNull()
    n = F.when(known, F.col("casos")).cast("double")
    margins = cells.withColumns(
        {
            "_n": n,
            "_r": F.sum(n).over(Window.partitionBy(*row)),
            "_c": F.sum(n).over(Window.partitionBy(*col)),
            "_in_row": F.count(n).over(Window.partitionBy(*row)),
            "_in_col": F.count(n).over(Window.partitionBy(*col)),
        }
    )
    total = margins.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0.0)).alias("_total"),
        F.count_distinct(F.when(known, F.col("valor1"))).alias("niveis1"),
        F.count_distinct(F.when(known, F.col("valor2"))).alias("niveis2"),
        F.sum(F.col("_n") * F.col("_n") / (F.col("_r") * F.col("_c"))).alias("_s"),
        F.sum(1.0 / (F.col("_r") * F.col("_in_row"))).alias("_inv_r"),
        F.sum(1.0 / (F.col("_c") * F.col("_in_col"))).alias("_inv_c"),
        F.max_by("_n", F.struct("valor1", "valor2")).alias("_o"),
        F.max_by(F.col("_r") * F.col("_c"), F.struct("valor1", "valor2")).alias("_rc"),
    )
    size = F.col("_total")
    plain = F.greatest(size * (F.col("_s") - 1.0), F.lit(0.0))
    gap = F.abs(F.col("_o") - F.try_divide(F.col("_rc"), size))
    corrected = F.pow(gap - F.least(F.lit(0.5), gap), 2) * size * F.col("_inv_r") * F.col("_inv_c")
    chi2 = F.when((F.col("niveis1") == 2) & (F.col("niveis2") == 2), corrected).otherwise(plain)
    spread = F.least("niveis1", "niveis2") - 1
    v = F.when(spread <= 0, F.lit(0.0)).otherwise(F.sqrt(F.try_divide(chi2, size * spread)))
    return total.select(
        *by,
        size.cast("bigint").alias("casos"),
        "niveis1",
        "niveis2",
        F.round(F.coalesce(v, F.lit(0.0)), digits).alias("cramers_v"),
    )


def cramers_v(df: DataFrame, var1: str, var2: str, exclude: Sequence[str] = (IGNORED,)) -> DataFrame:
    return cramers_v_of_cells(contingency(df, var1, var2, exclude))


def pair_cells(df: DataFrame, fields: Sequence[str], exclude: Sequence[str] = (IGNORED,)) -> DataFrame:
    """Contingency cells of every pair of fields, from one pass.

    Rows are first counted by their whole code vector. That grouping is as small as the code
    domains, combines in the map tasks, and only its result is spread over the pairs.
    """
    present = [f for f in fields if f in df.columns]
    vectors = df.groupBy(*present).agg(F.count(F.lit(1)).alias("_n"))

    def cell(a: str, b: str):
        known = F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.col(a).isin(*exclude) & ~F.col(b).isin(*exclude)
        known = F.coalesce(known, F.lit(False))
        return F.struct(
            F.lit(a).alias("var1"),
            F.lit(b).alias("var2"),
            F.when(known, F.col(a)).alias("valor1"),
            F.when(known, F.col(b)).alias("valor2"),
            F.when(known, F.col("_n")).otherwise(F.lit(0)).alias("casos"),
        )

    pairs = [cell(a, b) for a, b in combinations(present, 2)]
    return (
        vectors.select(F.inline(F.array(*pairs)))
        .groupBy("var1", "var2", "valor1", "valor2")
        .agg(F.sum("casos").alias("casos"))
    )


def association_matrix(df: DataFrame, fields: Sequence[str] = ASSOCIATION_FIELDS) -> DataFrame:
    """V of every pair of fields; a pair without common answers has V = 0."""
    return cramers_v_of_cells(pair_cells(df, fields), by=["var1", "var2"])


def strong_pairs(df: DataFrame, fields: Sequence[str] = ASSOCIATION_FIELDS, above: float = REPORTED_V) -> DataFrame:
    """Pairs above the reporting bound, strongest first."""
    return (
        association_matrix(df, fields)
        .filter(F.col("cramers_v") > above)
        .withColumn("interpretacao", F.when(F.col("cramers_v") >= STRONG_V, "FORTE").otherwise("MODERADA"))
        .orderBy(F.desc("cramers_v"), "var1", "var2")
    )
