"""Holdout metrics: ranking at k, confusion, Wilson intervals, open-set sweep and policy choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rate, wilson


def ranking_metrics(found: DataFrame, truth: DataFrame, relevant: DataFrame, scopes: tuple[str, ...] = ("all",), most: int = 5) -> DataFrame:
    """hit, precision, recall and reciprocal rank at k = 1..most. found: (query_id, rank, label); truth: (query_id, truth, scope); relevant: (truth, relevant).

    The three scopes are grouping sets: every query counts in `all` and in its own."""
    joined = truth.join(found, "query_id").join(relevant, "truth", "left")
    hits = joined.withColumn("hit", F.col("label") == F.col("truth")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).where("rank <= k")
    each = hits.groupBy("query_id", "scope", "k").agg(F.count_if("hit").alias("hits"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"), F.coalesce(F.max("relevant"), F.lit(0)).alias("relevant"))
    n = F.count(F.lit(1))
    made = each.groupingSets([["k"], ["k", "scope"]], "k", "scope").agg(n.alias("queries"), F.round(F.avg((F.col("hits") > 0).cast("double")), 12).alias("hit_rate"), F.round(F.avg(F.col("hits") / F.col("k")), 12).alias("precision"), F.round(F.avg(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant"))), 12).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))), 12).alias("mrr"))
    return made.select(F.coalesce("scope", F.lit("all")).alias("scope"), "k", "queries", "hit_rate", "precision", "recall", "mrr")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The 2 x 2 table, both recalls at 12 places, and the mean of these rounded recalls."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    made = df.agg(F.count_if(a & p).alias("tp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"))
    made = made.withColumn("recall_positive", rate(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("recall_negative", rate(F.col("tn"), F.col("tn") + F.col("fp")))
    return made.withColumn("balanced_accuracy", (F.col("recall_positive") + F.col("recall_negative")) / 2)


def open_set(df: DataFrame) -> DataFrame:
    """By known and unknown class: rows, accepted, coverage or false acceptance, rejection, with intervals. df: (known, accepted)."""
    made = df.groupBy("known").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("accepted"))
    w = wilson(F.col("accepted"), F.col("n"))
    return made.select("known", "n", "accepted", rate(F.col("accepted"), F.col("n")).alias("accepted_rate"), rate(F.col("n") - F.col("accepted"), F.col("n")).alias("rejected_rate"), w["low"].alias("low"), w["high"].alias("high"))


def sweep(df: DataFrame) -> DataFrame:
    """Every policy of margin in {0, 1} or observed and distance in {0} or eligible: known, unknown and correct rows accepted.

    A row is accepted by margin strictly above and distance at most; ties in distance enter together, so the running count is
    over RANGE. Rows are first counted by distinct (margin, distance), so equal rows meet as one. df: (nearest_distance,
    vote_margin, supported, known, correct)."""
    counts = df.groupBy("vote_margin", "nearest_distance").agg(*(F.count_if(F.col("supported") & c).alias(n) for n, c in (("known_n", F.col("known")), ("unknown_n", ~F.col("known")), ("correct_n", F.col("known") & F.col("correct")))))
    zero = df.sparkSession.createDataFrame([(0.0,), (1.0,)], "margin double")
    margins = counts.select(F.col("vote_margin").alias("margin")).unionAll(zero).distinct()
    eligible = margins.join(counts, F.col("vote_margin") > F.col("margin")).where("known_n + unknown_n > 0")
    points = eligible.select("margin", F.col("nearest_distance").alias("distance"), "known_n", "unknown_n", "correct_n").unionAll(margins.select("margin", F.lit(0.0), *(F.lit(0).cast("long"),) * 3))
    upto = Window.partitionBy("margin").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
    sums = points.groupBy("margin", "distance").agg(*(F.sum(c).alias(c) for c in ("known_n", "unknown_n", "correct_n")))
    return sums.select("margin", "distance", *(F.sum(f"{c}_n").over(upto).alias(f"{c}_accepted") for c in ("known", "unknown", "correct")))


def choose(swept: DataFrame, known: int, unknown: int, most_far: float, least_coverage: float) -> DataFrame:
    """The best policy: passing ones first, then most known accepted, lowest upper bound of false acceptance, smallest distance, largest margin."""
    far, cover = wilson(F.col("unknown_accepted"), F.lit(unknown))["high"], F.col("known_accepted") / F.lit(float(max(known, 1)))
    made = swept.withColumn("far_upper", far).withColumn("coverage", cover).withColumn("passes", (F.col("far_upper") <= most_far) & (F.col("coverage") >= least_coverage))
    return made.orderBy(F.desc("passes"), F.desc("known_accepted"), "far_upper", "distance", F.desc("margin")).limit(1)
