"""Global order in stretches, and sessions broken by duration, against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from oscilla.operators import ordering, sessions


def plain_lags(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))
    return {r: (ordered[k - 1][0] if k else None, k + 1) for k, r in enumerate(ordered)}


@pytest.mark.parametrize("kind", ["even", "one_hour", "one_instant", "text"])
def test_stretches_follow_the_density(spark, kind):
    """Rows all inside one hour, or at one instant, are parted as well as others; no stretch has twice the wanted rows."""
    rng, n, wanted = random.Random(kind), 4000, 500
    at = {"even": lambda: rng.randrange(10**12), "one_hour": lambda: 7 * sessions.DAY + rng.randrange(3_600_000_000), "one_instant": lambda: 5, "text": lambda: rng.randrange(3)}[kind]
    rows = [(at(), (f"é{i:05}" if kind == "text" else i * 7 % n)) for i in range(n)]
    df = spark.createDataFrame(rows, f"at long, position {'string' if kind == 'text' else 'long'}").repartition(5)
    cut = ordering.stretched(df, "at", "position", wanted)
    sizes = [r["count"] for r in cut.groupBy("stretch").count().collect()]
    assert len(sizes) >= n // wanted and max(sizes) < 2 * wanted
    made = ordering.running_sum(ordering.lagged(df, "at", "position", "before", wanted), F.lit(1), "number", "at", "position")
    assert {(r["at"], r["position"]): (r["before"], r["number"]) for r in made.collect()} == plain_lags(rows)


def test_nulls_come_first(spark):
    rows = [(None, 3), (None, None), (1, None), (1, 2), (1, 1), (0, 9), *((2, i) for i in range(60))]
    df = spark.createDataFrame(rows, "at long, position long")
    made = ordering.running_sum(ordering.stretched(df, "at", "position", 5), F.lit(1), "number", "at", "position")
    assert made.select("stretch").distinct().count() > 5
    assert {(r["at"], r["position"]): r["number"] for r in made.collect()} == {k: v[1] for k, v in plain_lags(rows).items()}
    empty = ordering.running_sum(ordering.stretched(df.limit(0), "at", "position", 5), F.lit(1), "number", "at", "position")
    assert empty.count() == 0


@pytest.mark.parametrize("rising", [True, False])
def test_latest_value_passes_over_stretches(spark, rising):
    rng = random.Random(4)
    rows = [(i, 0, rng.randrange(100) if rng.random() < 0.02 else None) for i in range(600)]
    df = ordering.stretched(spark.createDataFrame(rows, "at long, position long, x int"), "at", "position", 40)
    order = [F.col("at")] if rising else [-F.col("at")]
    found = {r["at"]: r["last_x"] for r in ordering.latest(df, F.col("x"), "last_x", order, rising).collect()}
    last, wanted = None, {}
    for at, _, x in rows if rising else reversed(rows):
        last = last if x is None else x
        wanted[at] = last
    assert found == wanted


def plain_parts(rows, limit):
    out, start, part, session = {}, None, 0, None
    for s, at, p in sorted(rows):
        if s != session:
            session, start, part = s, at, 1
        elif at - start >= limit:
            start, part = at, part + 1
        out[s, at, p] = part
    return out


@pytest.mark.parametrize("limit", [7, 50, 10_000])
def test_breaks_by_duration(spark, limit):
    """Session 1 has most rows, repeated instants among them, and hundreds of breaks; others are short or alone."""
    rng = random.Random(limit)
    at, rows = 0, []
    for i in range(2500):
        at += rng.choice([0, 1, 1, 2, 9])
        rows.append((1, at, i))
    for s in range(2, 12):
        at += 10**6
        rows += [(s, at + k * s, 10_000 * s + k) for k in range(s)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "session long, at long, position long, Part_ string").repartition(4)
    made = sessions.limit_duration(df, limit, stretch=300)
    assert made.columns == ["session", "at", "position", "Part_", "part"]
    assert {(r["session"], r["at"], r["position"]): r["part"] for r in made.collect()} == plain_parts(rows, limit)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "Pandas" not in plan
