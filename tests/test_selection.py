"""Quantiles of groups against sorted lists."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from oscilla.operators import selection

QS = (0.0, 0.5, 0.95, 1.0)


def plain(rows, qs):
    groups: dict = {}
    for k, v in rows:
        groups.setdefault(k, []).extend([v] if v is not None and math.isfinite(v) else [])
    out = set()
    for k, vs in groups.items():
        vs, n = sorted(vs), len(vs)
        for q in qs:
            place = (n - 1) * q
            out.add((k, q, n, *((vs[math.floor(place)], vs[math.ceil(place)], vs[max(0, math.ceil(n * q) - 1)]) if n else (None, None, None))))
    return out


@pytest.mark.parametrize("few", [2, 50, None])
def test_groups_of_all_kinds(spark, few):
    draw = random.Random(5)
    rows = [("hot", draw.gauss(0, 1)) for _ in range(3000)]
    rows += [("ties", draw.choice([1.0, 1.0, 1.0, 2.0])) for _ in range(500)] + [("one", 7.0)] * 300
    rows += [("wide", draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 308)) for _ in range(300)] + [("ends", -1.7e308), ("ends", 1.7e308), ("ends", 0.0)]
    rows += [("tiny", 5e-324 * i) for i in range(4)] + [(None, float(i)) for i in range(10)]
    rows += [("none", None), ("none", float("nan")), ("none", float("inf"))] + [(f"g{i}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    found = selection.quantiles(df, ["g"], F.col("v"), QS, few)
    assert {tuple(r) for r in found.collect()} == plain(rows, QS)


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "key int, value double")
    assert selection.quantiles(empty, ["key"], F.col("value"), QS).count() == 0
    df = spark.createDataFrame([(1, None, 3.0, 9), (1, None, 5.0, 9)], "key int, first string, value double, rank int")
    assert {tuple(r) for r in selection.quantiles(df, ["key", "first"], F.col("value"), (0.5,)).collect()} == {(1, None, 0.5, 2, 3.0, 5.0, 3.0)}


def test_no_interval_of_the_last_step_is_large(spark, monkeypatch):
    """All rows in one group: what a window orders at last is bounded, although rows are not."""
    seen, most = [], selection._most
    monkeypatch.setattr(selection, "_most", lambda live: seen.append(most(live)) or seen[-1])
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") * 37 % 200_000).cast("double").alias("v"))
    assert [tuple(r) for r in selection.quantiles(df, ["g"], F.col("v"), (0.5,), 100).collect()] == [(1, 0.5, 200_000, 99_999.0, 100_000.0, 99_999.0)]
    assert len(seen) == 2 and seen[-1] <= 100
