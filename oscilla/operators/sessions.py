"""Sessions in time, in one global order that no task holds (see ordering.py)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from . import ordering

DAY = 86_400_000_000


def gaps(df: DataFrame, instant: str = "at", position: str = "position", stretch: int | None = None) -> DataFrame:
    """Adds `gap`, the time since the row before in the order of (instant, position), null for the first, and the row's stretch."""
    return ordering.lagged(df, instant, position, "gap", stretch).withColumn("gap", F.col(instant) - F.col("gap"))


def gap_sessions(df: DataFrame, threshold: float, instant: str = "at", position: str = "position", stretch: int | None = None) -> DataFrame:
    """Adds `session`, from 1: a new one begins where the gap is strictly beyond the threshold."""
    return broken(gaps(df, instant, position, stretch), threshold, instant, position)


def broken(spaced: DataFrame, threshold: float, instant: str = "at", position: str = "position") -> DataFrame:
    """The same from rows that have their gaps, which no threshold changes."""
    starts = F.when(F.col("gap").isNull() | (F.col("gap") > threshold), 1).otherwise(0)
    return ordering.running_sum(spaced, starts, "session", instant, position)


def keyed_gap_sessions(df: DataFrame, keys: list[str], threshold: float, instant: str = "at", position: str = "position") -> DataFrame:
    """The same within each key."""
    order = Window.partitionBy(*keys).orderBy(instant, position)
    rows = df.withColumn("gap", F.col(instant) - F.lag(instant).over(order))
    return rows.withColumn("session", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > threshold), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def limit_duration(df: DataFrame, limit: int, instant: str = "at", position: str = "position", stretch: int | None = None) -> DataFrame:
    """Breaks sessions again where a row is `limit` or more after its session's current start; adds `part`, from 1 in each session.

    Which start is current depends on all breaks before. But the break after any instant, were it a start, is the first instant
    `limit` or more later, whatever came before: a link that one ordered pass finds for all instants. From each session's first
    instant the links are followed by doubling: links of 2^k breaks join themselves to links of 2^(k+1), and the starts known so
    far take one more link each, so rounds are the logarithm of the most breaks, and a session of all rows is spread like any
    other. Sessions shorter than the limit need none of this. `session` is a whole number that rises with time."""
    df = cut(df)  # read several times
    long = cut(df.groupBy("session").agg((F.max(instant) - F.min(instant) >= limit).alias("folds")).where("folds").select("session"))
    short = df.join(long, "session", "left_anti").select(*df.columns, F.lit(1).cast("long").alias("part"))
    if long.isEmpty():
        return short
    rows = df.join(long, "session", "left_semi").select(*df.columns)
    starts = _starts(rows.select("session", F.col(instant).alias("at")).distinct(), limit, stretch)
    both = rows.withColumn("kind", F.lit(1)).unionByName(starts.select("session", F.col("at").alias(instant), F.col("part").alias("begun"), F.lit(0).alias("kind")), allowMissingColumns=True)
    order = [F.col("session"), F.col(instant), F.col("kind"), F.col(position)]
    placed = ordering.latest(ordering.stretched(both, "session", instant, stretch), F.col("begun"), "part", order)
    return short.unionByName(placed.where("kind = 1").select(*df.columns, "part"))


def _starts(points: DataFrame, limit: int, stretch: int | None) -> DataFrame:
    """(session, at, part): where each part of each session starts. points: distinct (session, at)."""
    none = F.lit(None).cast("long")
    asked = points.select("session", (F.col("at") + limit).alias("at"), F.col("at").alias("asking"), F.lit(0).alias("kind"))
    both = ordering.stretched(asked.unionByName(points.select("session", "at", none.alias("asking"), F.lit(1).alias("kind"))), "session", "at", stretch)
    # From the end backwards, instants before the questions that fall on them: the last instant seen is the first one due.
    backwards = [-F.col("session"), -F.col("at"), -F.col("kind")]
    due = ordering.latest(both, F.when(F.col("kind") == 1, F.struct("session", "at")), "due", backwards, rising=False)
    links = cut(due.where("kind = 0 and due.session = session").select("session", F.col("asking").alias("at"), F.col("due.at").alias("next_at")))
    starts, length, known = cut(points.groupBy("session").agg(F.min("at").alias("at")).withColumn("part", F.lit(1).cast("long"))), 1, -1
    while starts.count() > known:
        known = starts.count()
        fresh = starts.join(links, ["session", "at"]).select("session", F.col("next_at").alias("at"), (F.col("part") + length).alias("part"))
        starts, length = cut(starts.unionByName(fresh)), 2 * length
        onwards = links.select("session", F.col("at").alias("next_at"), F.col("next_at").alias("after_at"))
        links = cut(links.join(onwards, ["session", "next_at"]).select("session", "at", F.col("after_at").alias("next_at")))
    return starts


def summary(df: DataFrame, by: list[str], instant: str = "at") -> DataFrame:
    """Rows, first and last instant of each session."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(instant).alias("start_at"), F.max(instant).alias("end_at"))


def evenly_spaced(total: int, wanted: int) -> Iterator[int]:
    """Positions i (n - 1) // (m - 1) of an evenly spaced sample."""
    if wanted >= total:
        yield from range(total)
    elif wanted == 1:
        yield 0
    else:
        yield from (i * (total - 1) // (wanted - 1) for i in range(wanted))
