"""Gold by period: partial states per month that merge, so that a load rebuilds the months it changes and no others.

Three small tables, one folder per month each, hold all that the monthly table and the national KPIs need. `ages` has counts and
sums per month and year of age, from which means and the exact median follow. `ids` has the distinct case numbers as bitmaps, which
merge exactly over any months. `states` has the states seen. A month is replaced as a whole, so running a load again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episurv.functions.columns import rate
from episurv.operators.rates import growth, true_count
from episurv.plans.gold import GAPS, MONTH, age_partials, monthly_of_partials

TABLES = ("ages", "ids", "states")


def read_months(spark: SparkSession, silver: str, months: Sequence[tuple[int, int]]) -> DataFrame:
    """These months of a silver table partitioned by ano and mes. The test is on the folders, so no other is read."""
    wanted = [(F.col("ano") == y) & (F.col("mes") == m) for y, m in months]
    return spark.read.parquet(silver).filter(reduce(Column.__or__, wanted, F.lit(False)))


def update_months(silver: DataFrame, folder: str, months: Sequence[tuple[int, int]] | None = None, key: str = "nu_notific") -> None:
    """Replace the partial states of the months that `silver` holds, or of `months`, also where they hold no case any more.

    The key is a whole number as text; cases whose key is not are refused, as a bitmap has no place for them.
    """
    number = F.col(key).try_cast("bigint")
    checked = F.when(F.col(key).isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("not a number: "), F.col(key)))).otherwise(number)
    parts = {
        "ages": age_partials(silver, key, elderly=true_count("is_idoso").alias("total_idosos")),
        "ids": silver.select(*MONTH, checked.alias("_id"))
        .filter("_id IS NOT NULL")
        .groupBy(*MONTH, F.bitmap_bucket_number("_id").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bitmap")),
        "states": silver.select(*MONTH, "sg_uf").distinct(),
    }
    spark = silver.sparkSession
    for name, part in parts.items():
        if months is not None:
            wanted = spark.createDataFrame([(y, m) for y, m in months], "ano int, mes int")
            empty = wanted.withColumn("ano_mes", F.format_string("%04d-%02d", "ano", "mes"))
            # A row without content replaces a month that is empty now.
            part = part.unionByName(empty.join(part.select("ano", "mes").distinct(), ["ano", "mes"], "left_anti"), allowMissingColumns=True)
        target = f"{folder}/{name}"
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ano", "mes").parquet(target)


def _states(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    found = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
    return found | {"ages": found["ages"].filter("total_casos > 0"), "ids": found["ids"].filter("bitmap IS NOT NULL")}


def monthly_table(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly gold table, all months, from the partial states alone."""
    of = _states(spark, folder)
    ids = of["ids"].groupBy(*MONTH).agg(F.sum(F.bitmap_count("bitmap")).alias("casos_unicos"))
    months = monthly_of_partials(of["ages"].drop("total_idosos"))
    columns = [F.coalesce("casos_unicos", F.lit(0).cast("bigint")).alias("casos_unicos") if c == "_ids" else F.col(c) for c in months.columns]
    return growth(months.join(ids, list(MONTH), "left").select(*columns), "total_casos", "ano_mes")


def distinct_cases(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """Distinct cases over a span of months, both ends included: bitmaps of a bucket merge before they are counted."""
    span = _states(spark, folder)["ids"].filter(F.col("ano_mes").between(first, last))
    merged = span.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return merged.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0).cast("bigint")).alias("casos_unicos"))


def national_table(spark: SparkSession, folder: str) -> DataFrame:
    """The national KPIs, one row, from the partial states alone."""
    of = _states(spark, folder)

    def total(name: str) -> Column:
        return F.sum(name)

    def mean_of(sums: str, counts: str) -> Column:
        return F.try_divide(F.sum(sums).cast("double"), F.sum(counts).cast("double"))

    age, n = F.col("nu_idade_n"), F.col("total_casos")
    gap = {v: k for k, v in GAPS.items()}
    notified, stay = gap["tempo_sintoma_notificacao"], gap["tempo_internacao"]
    kpis = of["ages"].agg(
        F.coalesce(total("total_casos"), F.lit(0).cast("bigint")).alias("total_casos"),
        *[total(a).alias(b) for a, b in (
            ("total_obitos", "total_obitos"), ("casos_com_desfecho", "casos_com_desfecho"), ("total_internados", "total_internacoes"),
            ("total_uti", "total_uti"), ("total_vacinados", "total_vacinados"), ("casos_com_info_vacina", "casos_com_info_vacina"),
            ("total_idosos", "total_idosos"),
        )],
        F.try_divide(F.sum(age * n).cast("double"), F.sum(F.when(age.isNotNull(), n)).cast("double")).alias("idade_media"),
        mean_of(f"_sum_{notified}", f"_n_{notified}").alias("tempo_notif"),
        mean_of(f"_sum_{stay}", f"_n_{stay}").alias("duracao_int"),
        rate(total("total_obitos"), total("casos_com_desfecho")).alias("taxa_mortalidade"),
        rate(total("total_uti"), total("total_internados")).alias("taxa_uti"),
        rate(total("total_vacinados"), total("casos_com_info_vacina")).alias("taxa_vacinacao"),
        rate(total("total_idosos"), total("total_casos")).alias("pct_idosos"),
    )
    states = of["states"].agg(F.count_distinct("sg_uf").alias("ufs_afetadas"))
    one = F.lit(True).alias("_one")
    joined = kpis.select("*", one).join(states.select("*", one), "_one").drop("_one")
    return joined.select("total_casos", "ufs_afetadas", *[c for c in kpis.columns if c != "total_casos"])
