"""Temporal split without leakage: whole sessions go to train, validation and test in time order; sessions too near to the next
part are purged; the gap threshold is fitted on the final train part alone, to a fixed point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordering, quantiles, sessions

RATIOS = (0.7, 0.15)
GAP_MULTIPLIER = 5
GAP_QUANTILE = 0.95
ROUNDS = 64


@dataclass(frozen=True)
class Boundaries:
    """Ordinals of the last session of train and of validation, and the instants that the two next parts begin with; 0 and null where there are too few sessions to cut."""

    train: int
    validation: int
    validation_start: int | None
    test_start: int | None


def occurrences(rows: DataFrame, session: str = "session", instant: str = "at", stretch: int | None = None) -> DataFrame:
    """session (ordinals from 1), n, start_at, end_at, and the running number of rows."""
    made = rows.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.min(instant).alias("start_at"), F.max(instant).alias("end_at"))
    return ordering.running_sum(ordering.stretched(made, "start_at", session, stretch), F.col("n"), "cumulative", "start_at", session).drop("stretch")


def boundaries(found: DataFrame, session: str = "session") -> Boundaries:
    """The two cuts nearest to the target shares, ties to the earliest; every part keeps a session at least.

    Fewer than three sessions can't be cut: all are test then, as nothing may be learnt from what can't be parted from it."""
    whole = found.agg(F.count(F.lit(1)).alias("k"), F.max("cumulative").alias("total")).first()
    if whole["k"] < 3:
        return Boundaries(0, 0, None, None)

    def nearest(target: float, low: int, high: int) -> int:
        near = F.struct(F.abs(F.col("cumulative") - target), F.col(session))
        return found.where(F.col(session).between(low, high)).agg(F.min_by(session, near).alias("b")).first()["b"]

    train = nearest(whole["total"] * RATIOS[0], 1, whole["k"] - 2)
    validation = nearest(whole["total"] * (RATIOS[0] + RATIOS[1]), train + 1, whole["k"] - 1)
    starts = {r[session]: r["start_at"] for r in found.where(F.col(session).isin(train + 1, validation + 1)).select(session, "start_at").collect()}
    return Boundaries(train, validation, starts[train + 1], starts[validation + 1])


def assign(found: DataFrame, at: Boundaries, threshold: float, session: str = "session") -> DataFrame:
    """Adds partition (null where purged) and exclusion. Ends rise with ordinals, so a walk back from each cut is this filter."""
    part = F.when(F.col(session) <= at.train, "train").when(F.col(session) <= at.validation, "validation").otherwise("test")
    next_start = F.when(F.col(session) <= at.train, F.lit(at.validation_start).cast("long")).when(F.col(session) <= at.validation, F.lit(at.test_start).cast("long"))
    distance = next_start - F.col("end_at")
    purged = F.coalesce(~((distance > 0) & (distance >= threshold)), F.lit(False))
    return found.withColumn("partition", F.when(~purged, part)).withColumn("exclusion", F.when(purged, "purge"))


def fit_threshold(rows: DataFrame, stretch: int | None = None) -> float:
    """max(5 x median, 95th percentile) of the positive gaps between train rows; 0 if there is none."""
    return _fitted(sessions.gaps(rows, stretch=stretch))


def _fitted(spaced: DataFrame) -> float:
    """Up to quantiles.SMALL gaps fit in one buffer, which takes one job; more are bracketed. Both are exact by the same rule."""
    gaps, qs = spaced.where("gap > 0").select("gap").persist(), (0.5, GAP_QUANTILE)
    n = gaps.count()
    if n <= quantiles.SMALL:
        values = gaps.agg(F.percentile("gap", F.array(*map(F.lit, qs))).alias("values")).first()["values"]
    else:
        values = quantiles.interpolated(gaps, {"gap": F.col("gap")}, qs).first()["values"]
    gaps.unpersist()
    return max(GAP_MULTIPLIER * values[0], values[1]) if n else 0.0


def sessioned(rows: DataFrame, threshold: float, limit: int | None, stretch: int | None = None) -> DataFrame:
    """Rows with the ordinal of their session, broken by gap and, if wanted, by duration."""
    return _sessioned(sessions.gaps(rows, stretch=stretch), threshold, limit, stretch).select(*rows.columns, "session")


def _sessioned(spaced: DataFrame, threshold: float, limit: int | None, stretch: int | None) -> DataFrame:
    kept = [c for c in spaced.columns if c != "stretch"]
    made = sessions.broken(spaced, threshold).drop("stretch")
    if limit is None:
        return made
    folded = sessions.limit_duration(made, limit, stretch=stretch)
    parts = folded.groupBy("session").agg(F.max("part").alias("parts"), F.min("at").alias("start_at"))
    upto = ordering.running_sum(ordering.stretched(parts, "start_at", "session", stretch), F.col("parts"), "upto", "start_at", "session")
    before = upto.select("session", (F.col("upto") - F.col("parts")).alias("before"))
    return folded.join(before, "session").select(*kept, (F.col("before") + F.col("part")).alias("session"))


def fixed_point(rows: DataFrame, limit: int | None = sessions.DAY, stretch: int | None = None) -> tuple[float, DataFrame]:
    """(threshold, occurrences with their parts). rows: (at in microseconds, position). Begins with every row on its own.

    Each round plans anew from the source with another literal, so nothing piles up; only thresholds and cuts reach the
    driver. A round's sessions are read several times, so they are kept for the round; gaps come with them. Train
    is what comes first in time, so its rows have the gaps that they have among all rows."""
    threshold, seen = -1.0, set()
    spaced = sessions.gaps(rows, stretch=stretch)
    for _ in range(ROUNDS):
        sessioned_rows = _sessioned(spaced, threshold, limit, stretch).persist()
        found = occurrences(sessioned_rows, stretch=stretch).persist()
        cuts = boundaries(found)
        if not cuts.train:
            raise ValueError("three sessions are needed at least")
        made = assign(found, cuts, max(threshold, 0.0))
        left = made.agg(F.max(F.when(F.col("partition") == "train", F.col("session"))).alias("train"), F.count_if(F.col("partition") == "validation").alias("validation")).first()
        last_train = left["train"]
        if last_train is None or not left["validation"]:
            raise ValueError("the purge emptied a part")
        fitted = _fitted(sessioned_rows.where(F.col("session") <= last_train))
        sessioned_rows.unpersist()
        if fitted == threshold:
            return threshold, made
        found.unpersist()
        if (fitted, last_train) in seen:
            break
        seen.add((fitted, last_train))
        threshold = fitted
    raise ValueError("the fit on the final train part did not converge")
