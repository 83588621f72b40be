"""Cramér's V against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from episurv.operators import association as assoc


def textbook(table, corrected):
    """Chi-square over the full grid, with the continuity correction on request."""
    rows, cols, n = [sum(r) for r in table], [sum(c) for c in zip(*table)], sum(map(sum, table))
    chi2 = 0.0
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            e = r * c / n
            gap = abs(table[i][j] - e)
            gap -= min(0.5, gap) if corrected else 0
            chi2 += gap * gap / e
    return math.sqrt(chi2 / (n * (min(len(rows), len(cols)) - 1)))


def frame(spark, table):
    rows = [(str(i + 10), str(j + 20)) for i, r in enumerate(table) for j, n in enumerate(r) for _ in range(n)]
    return spark.createDataFrame(rows, "a string, b string")


@pytest.mark.parametrize("table", [[[10, 20], [30, 5]], [[1, 0], [0, 1]], [[7, 7], [7, 7]], [[5, 0], [3, 9]],
                                   [[5, 0, 2], [3, 9, 1]], [[4, 1], [0, 6], [2, 2]], [[8, 0, 0], [0, 8, 0], [0, 0, 8]]])
def test_v_matches_the_textbook(spark, table):
    two_by_two = len(table) == 2 and len(table[0]) == 2
    got = assoc.cramers_v(frame(spark, table), "a", "b").first()
    assert got.cramers_v == pytest.approx(textbook(table, two_by_two), abs=1e-6)
    assert got.casos == sum(map(sum, table))


def test_one_level_gives_zero(spark):
    assert assoc.cramers_v(frame(spark, [[3, 4]]), "a", "b").first().cramers_v == 0.0


def test_ignored_codes_are_left_out_on_request(spark):
    df = spark.createDataFrame([("1", "1"), ("9", "1"), ("2", "9"), (None, "2"), ("2", "2")], "a string, b string")
    assert assoc.contingency(df, "a", "b").agg(F.sum("casos")).first()[0] == 2
    assert assoc.contingency(df, "a", "b", exclude=()).agg(F.sum("casos")).first()[0] == 4


def test_matrix_equals_the_pairs_and_keeps_empty_ones(spark):
    rows = [(str(i % 3), str(i % 2), "9", str((i * 7) % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "CS_SEXO string, FEBRE string, TOSSE string, UTI string")
    matrix = {(r.var1, r.var2): r.cramers_v for r in assoc.association_matrix(df).collect()}
    assert len(matrix) == 6
    assert matrix[("CS_SEXO", "TOSSE")] == 0.0
    assert matrix[("CS_SEXO", "UTI")] == assoc.cramers_v(df, "CS_SEXO", "UTI").first().cramers_v


def test_matrix_groups_code_vectors_before_the_pairs(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("string").alias("FEBRE"), (F.col("id") % 3).cast("string").alias("UTI"))
    plan = assoc.association_matrix(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.rindex("HashAggregate")
