"""Exact quantiles of every group at once, whatever a group's size: counts in bins narrow each group's places to a few values.

The state of a round is a set of intervals, known by their group and their least value. Rows of an interval are counted in BINS bins
between its least and its greatest value; counts say in which bin each sought rank lies, and only rows of those bins go on, equal
values as one row with their number. Small and large groups go through the same rounds together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..shared import kept

#: Bins of an interval, distinct values that a window may order, and rounds at most.
BINS, FEW, ROUNDS = 1024, 1 << 14, 12


def _ranks(n: Column, q: float) -> tuple[Column, Column, Column]:
    """Ranks, from 0, of the elements below and above the place of q and of the nearest one."""
    place = (n - 1) * F.lit(q)
    return F.floor(place), F.ceil(place), F.greatest(F.ceil(n * F.lit(q)) - 1, F.lit(0).cast("long"))


def _bin() -> Column:
    """The bin of a value inside its interval: rises with the value, as each step does. Halves, so that no range overflows."""
    half = lambda c: F.col(c) * 0.5
    wide = half("last") - half("first")
    return F.coalesce(F.floor((half("value") - half("first")) / F.nullif(wide, F.lit(0.0)) * BINS), F.lit(0).cast("long"))


def _passed(weight: str, by: list[str], order: str) -> Column:
    return F.sum(weight).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def _within() -> Column:
    """Whether the sought rank lies in a bin or value of `m` rows, up to whose end there are `below` + `upto`."""
    return (F.col("rank") < F.col("below") + F.col("upto")) & (F.col("rank") >= F.col("below") + F.col("upto") - F.col("m"))


def _most(live: DataFrame) -> int:
    """Distinct values of the fullest interval that has more than one value."""
    return live.where("first < last").groupBy("key", "first").count().agg(F.max("count")).first()[0] or 0


def quantiles(df: DataFrame, by: list[str], value: Column, qs: tuple[float, ...], few: int | None = None) -> DataFrame:
    """(*by, q, n, low, high, nearest) for each group and each q: n finite values; the elements at floor and ceil of (n - 1) q and at the nearest rank.

    Null, NaN and infinite values count for nothing; a group without finite values has n = 0 and null elements; a null in `by` is a
    group like others; an empty table gives no row. Zeros of both signs are one value. Values are doubles.
    Two scans of the source, and passes over what is left of it. A hot group is counted where its rows lie and needs no task of its
    own: tasks get BINS + 1 counts an interval and order `few` distinct values of one, beside what ROUNDS rounds cannot part, which is less than
    one in 1024 ** 12 of an interval's width. The driver gets two numbers a round."""
    few, x = few or FEW, value.cast("double")
    rows = df.select(F.struct(*by).alias("key"), F.when(finite(x), x + F.lit(0.0)).alias("value"))
    groups = kept(rows.groupBy("key").agg(F.count("value").alias("n"), F.min("value").alias("first"), F.max("value").alias("last")), "groups")
    ranks = F.array_distinct(F.array(*(r for q in qs for r in _ranks(F.col("n"), q))))
    sought = groups.where("n > 0").select("key", "first", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"))
    live = rows.where("value is not null").join(groups.select("key", "first", "last"), "key").withColumn("m", F.lit(1).cast("long"))
    most = groups.agg(F.max("n")).first()[0] or 0
    for _ in range(ROUNDS):
        if most <= few:
            break
        placed = live.withColumn("bin", _bin())
        counted = placed.groupBy("key", "first", "bin").agg(F.sum("m").alias("m"), F.min("value").alias("least"), F.max("value").alias("most"))
        counted = counted.withColumn("upto", _passed("m", ["key", "first"], "bin"))
        chosen = kept(sought.join(counted, ["key", "first"]).where(_within()).withColumn("below", F.col("below") + F.col("upto") - F.col("m")), "chosen")
        sought = chosen.select("key", F.col("least").alias("first"), "rank", "below")
        left = placed.join(chosen.select("key", "first", "bin", "least", "most").distinct(), ["key", "first", "bin"])
        left = left.select("key", F.col("least").alias("first"), F.col("most").alias("last"), "value", "m")
        live = kept(left.groupBy("key", "first", "last", "value").agg(F.sum("m").alias("m")), "left")
        most = _most(live)
    distinct = live.groupBy("key", "first", "value").agg(F.sum("m").alias("m")).withColumn("upto", _passed("m", ["key", "first"], "value"))
    found = sought.join(distinct, ["key", "first"]).where(_within()).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    asked = groups.join(found, "key", "left").withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs))))
    elements = [F.coalesce(*(F.when(F.col("q") == q, F.try_element_at("at", _ranks(F.col("n"), q)[i])) for q in qs)).alias(name) for i, name in enumerate(("low", "high", "nearest"))]
    return asked.select(*(F.col("key")[c].alias(c) for c in by), "q", "n", *elements)


def between(low: Column, high: Column, n: Column, q: Column) -> Column:
    """The interpolated quantile (type 7) of the elements at both sides of its place."""
    place = (n - 1) * q
    return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)
