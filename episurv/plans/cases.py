"""Raw notifications derived from the order tables.

The tables at hand hold no notifications, so orders, customers and nations are recast as the raw
all-text records the operators read: mixed date formats, missing and impossible dates, ignored
codes, empty strings and re-notified cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episurv.functions.reshape import with_values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dmy(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def _mixed_text(d: Column, j: Column) -> Column:
    return (
        F.when(j % 101 == 0, F.lit("99/99/9999"))
        .when(j % 97 == 0, F.lit(None).cast("string"))
        .when(j % 10 == 0, F.date_format(d, "yyyy-MM-dd"))
        .otherwise(_dmy(d))
    )


def _digit(key: Column, modulus: int, answers: dict[int, str | None], other: str | None) -> Column:
    out = F.lit(other).cast("string")
    for rest, answer in answers.items():
        out = F.when(key % modulus == rest, F.lit(answer).cast("string")).otherwise(out)
    return out


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as one raw notification; one in fifty is notified twice.

    No join hint: nation has a fixed size and Catalyst broadcasts it by its file size, customer
    grows with the data and is broadcast only while it is small.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .withColumn(
            "rep",
            F.explode(
                F.when(F.col("o_orderkey") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
                    F.array(F.lit(0))
                )
            ),
        )
    )
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    d = F.to_date("o_orderdate")
    k9, k5, k3, k21 = [(k % m).cast("int") for m in (9, 5, 3, 21)]
    admitted = k % 10 < 8
    icu = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "1")
        .when(F.col("o_orderpriority") == "5-LOW", "9")
        .otherwise("2")
    )
    outcome = F.when(F.col("o_orderstatus") == "F", "2").when(F.col("o_orderstatus") == "O", "1").otherwise("9")
    # Formatted once per row, like the text of a file.
    dates = {
        "DT_NOTIFIC": _mixed_text(F.date_add(d, k9 - 1 + F.col("rep")), k + 13),
        "DT_SIN_PRI": _mixed_text(d, k),
        "DT_INTERNA": F.when(admitted, _dmy(F.date_add(d, k5))),
        "DT_ENTUTI": F.when(admitted & (icu == "1"), _dmy(F.date_add(d, k5 + k3))),
        "DT_EVOLUCA": F.when(admitted & (outcome != "9"), _dmy(F.date_add(d, k5 + k21 - 1))),
    }
    return with_values(joined, dates).select(
        k.cast("string").alias("NU_NOTIFIC"),
        "DT_NOTIFIC",
        "DT_SIN_PRI",
        F.weekofyear(d).cast("string").alias("SEM_PRI"),
        F.year(d).alias("ANO_DADOS"),
        F.when(ck % 20 == 0, "I").when(ck % 2 == 1, "M").otherwise("F").alias("CS_SEXO"),
        (ck * 7 % 130).cast("string").alias("NU_IDADE_N"),
        F.when(k % 11 == 0, "2").otherwise("3").alias("TP_IDADE"),
        F.when(k % 89 != 0, F.col("n_name")).alias("SG_UF"),
        (ck % 300).cast("string").alias("CO_MUN_RES"),
        _digit(k, 3, {0: "1", 1: "2"}, "9").alias("FEBRE"),
        _digit(k, 7, {0: "9", 1: "2", 2: ""}, "1").alias("TOSSE"),
        _digit(k, 5, {0: "2", 1: "9"}, "1").alias("DISPNEIA"),
        F.when(admitted, "1").when(k % 10 == 8, "2").otherwise("9").alias("HOSPITAL"),
        icu.alias("UTI"),
        outcome.alias("EVOLUCAO"),
        _digit(k, 4, {0: "1", 1: "2", 2: "9"}, None).alias("VACINA"),
        "DT_INTERNA",
        "DT_ENTUTI",
        "DT_EVOLUCA",
    )
