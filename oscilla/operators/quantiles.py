"""Exact quantiles of many columns at once without ordering a table in one task: a sketch brackets each place, exact counts
below and inside the bracket find it."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite

#: A sketch of this accuracy errs by n / ACCURACY ranks at most; a bracket reaches SLACK of all ranks to both sides, well beyond that error.
ACCURACY, SLACK = 20_000, 1.25e-4
#: Below this count a bracket would reach 10 ranks or less, so it spans all values.
SMALL = 80_000


@dataclass(frozen=True)
class Bracket:
    """Values from first to last of a column, how many lie below and inside, and the place of a quantile among n values."""

    column: int
    place: int
    q: float
    n: int
    first: float | None
    last: float | None
    below: int
    inside: int

    def holds(self) -> bool:
        """Whether the elements at both ranks beside the place, and at the nearest, lie inside."""
        ranks = (math.floor((self.n - 1) * self.q), math.ceil((self.n - 1) * self.q), max(0, math.ceil(self.n * self.q) - 1))
        return not self.n or self.below <= min(ranks) and max(ranks) < self.below + self.inside


def _bracketed(rows: DataFrame, columns: Iterable[int], qs: tuple[float, ...], slack: float) -> list[Bracket]:
    """A bracket for each column and place by a sketch, and its counts by a second scan."""
    edges = [max(q - slack, 0.0) for q in qs] + [min(q + slack, 1.0) for q in qs]
    one = lambda i: F.struct(F.count(f"x{i}").alias("n"), F.min(f"x{i}").alias("least"), F.max(f"x{i}").alias("most"), F.percentile_approx(f"x{i}", edges, ACCURACY).alias("e")).alias(f"s{i}")
    found, made = rows.agg(*map(one, columns)).first(), []
    for i in columns:
        s = found[f"s{i}"]
        for k, q in enumerate(qs):
            whole = s["n"] < SMALL or slack >= 1
            made.append((i, k, q, s["n"], *((s["least"], s["most"]) if whole else (s["e"][k], s["e"][k + len(qs)]))))
    counted = [(F.count_if(F.col(f"x{i}") < first).alias(f"b{i}_{k}"), F.count_if(F.col(f"x{i}").between(first, last)).alias(f"i{i}_{k}")) for i, k, _, n, first, last in made if n]
    counts = rows.agg(*(c for pair in counted for c in pair)).first() if counted else {}
    return [Bracket(*b, *((counts[f"b{b[0]}_{b[1]}"], counts[f"i{b[0]}_{b[1]}"]) if b[3] else (0, 0))) for b in made]


def elements(df: DataFrame, columns: dict[str, Column], qs: tuple[float, ...]) -> DataFrame:
    """(column_name, q, n, low, high, nearest) over finite values: the elements at floor and ceil of (n - 1) q and at the nearest rank; null where n is 0.

    Three scans of the columns, two more for each time that a sketch erred beyond its slack; the driver gets a few numbers for each quantile. One task orders the distinct values of a bracket, 2.5e-4 of all rows or SMALL distinct values at most beside those equal to its ends."""
    names = list(columns)
    rows = df.select(*(F.when(finite(e.cast("double")), e.cast("double")).alias(f"x{i}") for i, e in enumerate(columns.values())))
    brackets, slack = _bracketed(rows, range(len(names)), qs, SLACK), SLACK
    # What a sketch promises is not taken on trust: ranks outside their bracket are sought in wider ones, at last in all values.
    while wrong := [b for b in brackets if not b.holds()]:
        slack = min(1.0, 16 * slack)
        wider = {(b.column, b.place): b for b in _bracketed(rows, sorted({b.column for b in wrong}), qs, slack)}
        brackets = [b if b.holds() else wider[b.column, b.place] for b in brackets]
    numbered = [(k, names[b.column], float(b.q), b.n, b.below, b.first, b.last, b.column) for k, b in enumerate(brackets)]
    asked = df.sparkSession.createDataFrame([b[:5] for b in numbered], "place int, column_name string, q double, n long, below long")
    inside = [F.when(F.col(f"x{i}").between(first, last), F.struct(F.lit(place).alias("place"), F.col(f"x{i}").alias("value"))) for place, _, _, n, _, first, last, i in numbered if n]
    counted = rows.select(F.explode(F.array_compact(F.array(*inside or [F.lit(None).cast("struct<place: int, value: double>")]))).alias("v")).groupBy("v.place", "v.value").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("place").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ordered = counted.withColumn("upto", upto).join(F.broadcast(asked), "place")
    at = lambda rank: F.min(F.when(F.col("below") + F.col("upto") > rank, F.col("value")))
    position = (F.col("n") - 1) * F.col("q")
    picked = ordered.groupBy("place").agg(at(F.floor(position)).alias("low"), at(F.ceil(position)).alias("high"), at(F.greatest(F.ceil(F.col("n") * F.col("q")) - 1, F.lit(0))).alias("nearest"))
    return asked.join(F.broadcast(picked), "place", "left").select("column_name", "q", "n", "low", "high", "nearest")


def interpolated(df: DataFrame, columns: dict[str, Column], qs: tuple[float, ...]) -> DataFrame:
    """(column_name, n, values): type-7 quantiles in the order of qs."""
    position = (F.col("n") - 1) * F.col("q")
    down, up = F.floor(position), F.ceil(position)
    value = F.when(down == up, F.col("low")).otherwise((up - position) * F.col("low") + (position - down) * F.col("high"))
    made = elements(df, columns, qs).withColumn("value", value)
    return made.groupBy("column_name").agg(F.max("n").alias("n"), F.array(*(F.max(F.when(F.col("q") == q, F.col("value"))) for q in qs)).alias("values"))
