"""Request rates in sliding windows, and the limiter that admits or denies requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits per minute and hour.
MAX_PER_MINUTE, MAX_PER_HOUR = 100, 500
MINUTE, HOUR = 60_000_000, 3_600_000_000


# Requests are counted in slices this long. A slice is the unit of work, so a key or an hour that
# holds a large share of the rows is spread over its slices.
SLICE = MINUTE


def _whole(c: str, size: int) -> Column:
    """How many whole units of a size fit, rounded down, in whole-number arithmetic."""
    return ((F.col(c) - F.pmod(F.col(c), F.lit(size))) / F.lit(size)).cast("bigint")


def offered_load(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Requests of the key in the last minute and the last hour, the request itself included.

    A window is open at its old end: a request exactly one minute old is out. The count of a
    window is a difference of two running counts, at the request and one window before it. A
    running count is the position within a slice of time plus the sizes of the slices before it.
    So no frame of a whole window is kept or added up again, and no task sorts a whole key.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))

    def point(kind: int, back: int, weight: int) -> Column:
        return F.struct(F.lit(kind).alias("_kind"), (at - back).alias("_point"), F.lit(weight).alias("_weight"))

    points = df.select(
        key, tie, ts, at.alias("_at"), F.inline(F.array(point(0, 0, 1), point(1, MINUTE, 0), point(2, HOUR, 0)))
    ).withColumn("_slice", _whole("_point", SLICE))
    within = Window.partitionBy(key, "_slice").orderBy("_point").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = points.groupBy(key, "_slice").agg(F.sum("_weight").alias("_size"))
    offsets = sizes.select(key, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    counted = points.withColumn("_in_slice", F.sum("_weight").over(within)).join(offsets, [key, "_slice"])
    running = F.col("_offset") + F.col("_in_slice")

    def at_point(kind: int) -> Column:
        return F.max(F.when(F.col("_kind") == kind, running))

    return counted.groupBy(key, tie, ts, "_at").agg(
        (at_point(0) - at_point(1)).alias("no_ultimo_minuto"), (at_point(0) - at_point(2)).alias("na_ultima_hora")
    )


def rate_usage(
    df: DataFrame, key: str, ts: str, tie: str, per_minute: int = MAX_PER_MINUTE, per_hour: int = MAX_PER_HOUR
) -> DataFrame:
    """Load at each request and its share of the limits."""
    return (
        offered_load(df, key, ts, tie)
        .withColumns(
            {
                "uso_minuto_pct": F.col("no_ultimo_minuto") * 100.0 / F.lit(float(per_minute)),
                "uso_hora_pct": F.col("na_ultima_hora") * 100.0 / F.lit(float(per_hour)),
            }
        )
        .drop("_at")
    )


class SlidingLimiter:
    """Two sliding windows over admitted requests; a denied request leaves no trace."""

    def __init__(self, per_minute: int, per_hour: int, minute=(), hour=()):
        self.limits = ((MINUTE, per_minute, deque(minute)), (HOUR, per_hour, deque(hour)))

    def verdict(self, at: int) -> str:
        for span, _, admitted in self.limits:
            while admitted and admitted[0] <= at - span:
                admitted.popleft()
        (_, per_minute, minute), (_, per_hour, hour) = self.limits
        if len(minute) >= per_minute:
            return "negado_minuto"
        if len(hour) >= per_hour:
            return "negado_hora"
        minute.append(at)
        hour.append(at)
        return "permitido"


def _replay(key: str, tie: str, per_minute: int, per_hour: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limiter = None, None
        for pdf in batches:
            verdicts = []
            for group, at, warm_up in zip(zip(pdf[key], pdf["_island"]), pdf["_at"], pdf["_warm_up"]):
                if group != current:
                    current, limiter = group, SlidingLimiter(per_minute, per_hour)
                verdict = limiter.verdict(int(at))
                verdicts.append(None if warm_up else verdict)
            out = pd.DataFrame({key: pdf[key], tie: pdf[tie], "veredito": verdicts})
            yield out[out["veredito"].notna()]

    return run


def rate_limit(
    df: DataFrame, key: str, ts: str, tie: str, per_minute: int = MAX_PER_MINUTE, per_hour: int = MAX_PER_HOUR
) -> DataFrame:
    """Verdict of the limiter for every request, in time order per key.

    A verdict depends on earlier verdicts, but only where the limits bite. A request whose offered
    load is within both limits is admitted whatever happened before, because the admitted are
    among the offered. An hour in which all requests are like that fixes the state at its end: all
    of them were admitted. So only runs of hours with some request above a limit are replayed, each
    run on its own, started with the hour before it. A run streams through a sorted partition with
    at most `per_hour` timestamps of state; it is never held as a whole.
    """
    requests = df.select(key, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")).withColumn(
        "_hour", _whole("_at", HOUR)
    )
    above = (F.col("no_ultimo_minuto") > per_minute) | (F.col("na_ultima_hora") > per_hour)
    busy = offered_load(df, key, ts, tie).filter(above).select(key, _whole("_at", HOUR).alias("_hour")).distinct()
    runs = busy.withColumn(
        "_island", F.col("_hour") - F.row_number().over(Window.partitionBy(key).orderBy("_hour"))
    )
    # Each busy hour takes part in its run; the hour before a run takes part as warm-up. An hour can
    # only be warm-up when it is not busy itself.
    first = runs.groupBy(key, "_island").agg((F.min("_hour") - 1).alias("_hour")).withColumn("_warm_up", F.lit(True))
    parts = runs.withColumn("_warm_up", F.lit(False)).unionByName(first)
    to_replay = requests.join(parts, [key, "_hour"])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    replayed = (
        to_replay.select(key, "_island", "_at", tie, "_warm_up")
        .repartition(key, "_island")
        .sortWithinPartitions(key, "_island", "_at", tie)
        .mapInPandas(
            _replay(key, tie, per_minute, per_hour), f"{key} {kinds[key]}, {tie} {kinds[tie]}, veredito string"
        )
    )
    calm = requests.join(busy, [key, "_hour"], "left_anti").select(key, tie, F.lit("permitido").alias("veredito"))
    return replayed.unionByName(calm)
