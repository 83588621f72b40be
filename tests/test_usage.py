"""The limiter against a plain replay, and dialogue history against a plain loop."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from episurv.operators import audit, usage
from episurv.operators.dialogue import with_history

SECOND = 1_000_000


def replay(times, per_minute, per_hour):
    admitted, out = [], []
    for t in times:
        minute = [a for a in admitted if a > t - 60 * SECOND]
        hour = [a for a in admitted if a > t - 3600 * SECOND]
        if len(minute) >= per_minute:
            out.append("negado_minuto")
        elif len(hour) >= per_hour:
            out.append("negado_hora")
        else:
            out.append("permitido")
            admitted.append(t)
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "k string, n long, us long")
    return df.select("k", "n", F.timestamp_micros("us").alias("ts"))


def verdicts(spark, rows, per_minute, per_hour):
    got = usage.rate_limit(frame(spark, rows), "k", "ts", "n", per_minute, per_hour).collect()
    assert len(got) == len(rows)
    return {(r.k, r.n): r.veredito for r in got}


def test_denied_requests_leave_no_trace(spark):
    times = [i * SECOND // 2 for i in range(101)] + [61 * SECOND]
    rows = [("a", i, t) for i, t in enumerate(times)]
    got = verdicts(spark, rows, 100, 500)
    assert got[("a", 99)] == "permitido" and got[("a", 100)] == "negado_minuto" and got[("a", 101)] == "permitido"


def test_a_request_exactly_a_minute_old_is_out(spark):
    got = verdicts(spark, [("a", 0, 0), ("a", 1, 60 * SECOND - 1), ("a", 2, 60 * SECOND)], 1, 10)
    assert [got[("a", i)] for i in range(3)] == ["permitido", "negado_minuto", "permitido"]


@pytest.mark.parametrize("seed", range(4))
def test_limiter_equals_a_plain_replay(spark, seed):
    rng = random.Random(seed)
    rows, expected, n = [], {}, 0
    for key in ("calm", "hot", "bursts"):
        t, times = 0, []
        for _ in range(400):
            t += int({"calm": rng.expovariate(1 / 2400), "hot": rng.expovariate(1 / 40),
                      "bursts": rng.choice([1, 2, 3, 5000, 9000]) * rng.random()}[key] * SECOND)
            times.append(t)
        ids = list(range(n, n + len(times)))
        n += len(times)
        rows += [(key, i, t) for i, t in zip(ids, times)]
        expected.update({(key, i): v for i, v in zip(ids, replay(times, 3, 20))})
    rng.shuffle(rows)
    got = verdicts(spark, rows, 3, 20)
    assert got == expected
    assert {"permitido", "negado_minuto", "negado_hora"} == set(got.values())


def test_calm_requests_are_not_replayed(spark):
    rows = [("a", i, i * 120 * SECOND) for i in range(50)]
    plan = usage.rate_limit(frame(spark, rows), "k", "ts", "n")
    assert set(plan.toPandas()["veredito"]) == {"permitido"}


def test_usage_counts_across_the_hour(spark):
    rows = [("a", 0, 3599 * SECOND), ("a", 1, 3601 * SECOND), ("a", 2, 7199 * SECOND), ("b", 3, 3601 * SECOND)]
    got = {r.n: (r.no_ultimo_minuto, r.na_ultima_hora) for r in usage.rate_usage(frame(spark, rows), "k", "ts", "n").collect()}
    assert got == {0: (1, 1), 1: (2, 2), 2: (1, 2), 3: (1, 1)}


def history(turns):
    past, out = [], {}
    for i, (role, text) in enumerate(turns):
        if role != "user":
            continue
        if past:
            out[i] = "Histórico recente:\n" + "".join(f"P: {q}\nR: {a[:100]}...\n\n" for q, a in past[-3:]) + f"\nPergunta atual: {text}"
        else:
            out[i] = text
        if i + 1 < len(turns) and turns[i + 1][0] == "assistant":
            past.append((text, turns[i + 1][1]))
    return out


def test_history_equals_a_plain_loop(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for conv in range(6):
        turns = [(rng.choice(["user", "user", "assistant", "system"]), f"text {conv} {i} " + "x" * rng.randint(0, 150)) for i in range(60)]
        rows += [(conv, i, role, text) for i, (role, text) in enumerate(turns)]
        expected.update({(conv, i): text for i, text in history(turns).items()})
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    got = {(r.conv_id, r.turn): r.contexto for r in with_history(df).collect()}
    assert got == expected


def test_history_is_numbered_across_blocks(spark):
    from episurv.operators.dialogue import exchanges

    rows = [(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r.anteriores for r in exchanges(df, block=16).collect()}
    assert got == {i: i // 2 for i in range(0, 100, 2)}


def test_sums_do_not_depend_on_order(spark):
    """Doubles added up in these orders end on both sides of the half and of the bound."""
    half = [0.1, 0.2, 0.3, 0.7, *[0.01] * 28]  # 1.58 / 32 = 0.049375
    logs = []
    for n, order in enumerate(itertools.permutations([0.1, 0.2, 0.3, 1.8, 0.6, 0.0])):  # the mean is 0.5, the largest is 1.8
        logs += [(f"a{n}", x) for x in order]
    for n, order in enumerate(itertools.permutations([0.7, 0.1, 0.2, 0.2, 0.0, 0.0])):  # the mean is 0.2
        logs += [(f"b{n}", x) for x in order]
    logs += [("half", x) for x in half] + [("flah", x) for x in half[::-1]]
    rows = spark.createDataFrame(logs, "session_id string, elapsed_seconds double").selectExpr(
        "session_id", "'t' AS event_type", "'success' AS status", "timestamp'2024-01-01' AS timestamp", "elapsed_seconds"
    )
    found = {}
    for r in audit.performance(rows.coalesce(1)).collect():
        found.setdefault(r["session_id"].rstrip("0123456789"), set()).add(r["total_seconds"])
    assert found == {"a": {3.0}, "b": {1.2}, "half": {1.58}, "flah": {1.58}}
    odd = rows.limit(2).withColumn("elapsed_seconds", F.when(F.col("elapsed_seconds") == 0.1, 1e300).otherwise(1e-30))
    assert audit.performance(odd).first()["total_seconds"] == 1e300
