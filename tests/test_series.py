"""Series operators: short series, ties, gaps."""

from pyspark.sql import functions as F

from episurv.operators import series

SCHEMA = "k string, t int, v double"


def frame(spark, **lists):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in lists.items() for i, v in enumerate(vs)], SCHEMA)


def test_trend_labels(spark):
    df = frame(spark, up=[1, 2, 3, 2, 5], down=[5, 4, 3, 2], flat=[1, 2, 1, 2, 1], one=[7], same=[3, 3, 3], edge=[1, 2, 3, 4, 3, 2])
    labels = {r.k: r.tendencia for r in series.trend(df, ["k"], "t", "v").collect()}
    assert labels == {"up": "crescente", "down": "decrescente", "flat": "estável", "one": "insufficient_data",
                      "same": "estável", "edge": "estável"}


def test_first_to_last(spark):
    df = frame(spark, a=[10, 1, 15], zero=[0, 5], one=[4])
    got = {r.k: r.crescimento_pct for r in series.first_to_last_growth(df, ["k"], "t", "v").collect()}
    assert got == {"a": 50.0, "zero": 0.0, "one": 0.0}


def test_strict_moving_mean(spark):
    df = frame(spark, long=[1, 2, 3, 4, 5], short=[1, 2])
    got = [(r.k, r.m) for r in series.strict_moving_mean(df, ["k"], "t", "v", 3, "m").orderBy("k", "t").collect()]
    assert got == [("long", None), ("long", None), ("long", 2.0), ("long", 3.0), ("long", 4.0), ("short", 1.0), ("short", 2.0)]


def test_peaks_need_both_neighbours_and_height(spark):
    df = frame(spark, a=[1, 10, 1, 5, 1, 9.5, 9.5, 2, 9.1, 3], edge=[9, 1, 8])
    got = [(r.k, r.posicao) for r in series.peaks(df, ["k"], "t", "v").orderBy("k", "t").collect()]
    assert got == [("a", 1), ("a", 8)]


def test_rank_and_share(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 10)], "k string, n int")
    ranked = series.with_share(series.ranked(df, "n", "k", "r"), "n")
    assert [(r.k, r.r, r.percentual) for r in ranked.orderBy("r").collect()] == [("c", 1, 50.0), ("a", 2, 25.0), ("b", 3, 25.0)]


def test_bands(spark):
    def label(value, bands):
        return spark.range(1).select(F.lit(value).cast("double").alias("x")).select(series.rate_band("x", bands)).first()[0]

    assert [label(x, series.MORTALITY_BANDS) for x in (10.1, 10, 5.1, 5, None)] == [
        "alta", "moderada", "moderada", "controlada", "dados_insuficientes"]
    assert label(0, series.GROWTH_BANDS) == "estabilizacao_ou_reducao"
