"""Exact nearest neighbours with abstention: scaler, ranking, vote, policy, index checks."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import vectors
from . import ordering, sessions

#: Neighbours of a prediction, and rows that a policy is fitted on at most.
TOP_K, CALIBRATION = 5, 512
#: Vectors a side of one block of the distance grid at most, and training vectors of a block at least, where there are idle cores.
BLOCK, LEAST_BLOCK = 4096, 128


def scaler(df: DataFrame, v: str = "v") -> DataFrame:
    """One row: mean and scale arrays (population deviation, 1 where it is 0) and the number of rows. One pass over (place, value)."""
    flat = df.select(F.posexplode(v).alias("place", "x"))
    each = flat.groupBy("place").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.count(F.lit(1)).alias("n"))
    each = each.withColumn("scale", F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(1.0))
    made = each.agg(F.array_sort(F.collect_list(F.struct("place", "mean", "scale", "variance"))).alias("all"), F.max("n").alias("n"))
    return made.select(F.col("all.mean").alias("mean"), F.col("all.scale").alias("scale"), F.col("all.variance").alias("variance"), "n")


def standardized(df: DataFrame, fitted: DataFrame, v: str = "v") -> DataFrame:
    """v replaced by its standard form; the scaler is one row."""
    rest = [c for c in df.columns if c != v]
    return df.crossJoin(F.broadcast(fitted.select("mean", "scale"))).select(*rest, vectors.standardize(F.col(v), F.col("mean"), F.col("scale")).alias(v))


def ranked(queries: DataFrame, train: DataFrame, k: int = TOP_K, exclude_self: bool = False, rows: int | None = None) -> DataFrame:
    """(query_id, rank, ref, label, distance): the k nearest, ties to the smaller ref. queries: (query_id, v); train: (ref, label, v).

    Both sides are dealt into blocks and each two blocks meet in one group of bounded size on either side, which hands on k
    rows a query. In a group, matrix products find all rows that can be among the k nearest, with room for their rounding;
    these are measured exactly. Rows without a vector take no part."""
    spread = train.sparkSession.sparkContext.defaultParallelism
    parts = lambda n: max(1, -(-n // BLOCK), min(spread, n // LEAST_BLOCK))
    across, down = parts(train.count() if rows is None else rows), max(1, -(-queries.count() // BLOCK))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = train.where("v is not null").select(dealt("ref", across).alias("block"), every(down).alias("asking"), "ref", "label", F.col("v").alias("x"))
    theirs = queries.where("v is not null").select(every(across).alias("block"), dealt("query_id", down).alias("asking"), "query_id", F.col("v").alias("q"))

    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("ref", train.schema["ref"].dataType), T.StructField("label", train.schema["label"].dataType), T.StructField("distance", T.DoubleType())])
    nothing = to_arrow_schema(kinds).empty_table()

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing
        left = left.sort_by("ref")
        found = vectors.nearest(vectors.matrix(right["q"]), vectors.matrix(left["x"]), k, *([right["query_id"].to_numpy(), left["ref"].to_numpy()] if exclude_self else []))
        spot, row = pa.array(found[0]), pa.array(found[1])
        return pa.table({"query_id": right["query_id"].take(spot), "ref": left["ref"].take(row), "label": left["label"].take(row), "distance": pa.array(found[2])})

    met = ours.groupBy("block", "asking").cogroup(theirs.groupBy("block", "asking")).applyInArrow(near, kinds)
    last = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "ref"))
    return met.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "ref", "label", "distance")


def nearest_of_one(train: DataFrame, query: DataFrame, k: int = TOP_K) -> DataFrame:
    """ranked for a single query row, by one scan of train and the k least: the plan of a request, without blocks. query: one row."""
    one = F.broadcast(query.select("query_id", F.col("v").alias("q")).limit(1))
    found = train.where("v is not null").crossJoin(one).withColumn("distance", vectors.euclidean(F.col("v"), F.col("q")))
    least = found.select("query_id", "ref", "label", "distance").orderBy("distance", "ref").limit(k)
    return least.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "ref"))).select("query_id", "rank", "ref", "label", "distance")


def evenly_spaced_ids(df: DataFrame, key: str, wanted: int) -> list[int]:
    """At most `wanted` ids, evenly spaced in their order."""
    numbered = ordering.running_sum(ordering.stretched(df.select(key), key, key), F.lit(1), "number", key, key)
    numbers = [i + 1 for i in dict.fromkeys(sessions.evenly_spaced(df.count(), wanted))]
    return [r[key] for r in numbered.where(F.col("number").isin(numbers)).orderBy("number").collect()]


def voted(found: DataFrame) -> DataFrame:
    """For each query: winner by (most votes, smallest sum of distances, label), its votes, share, the margin to the second, and the nearest distance."""
    each = found.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"), F.sum("distance").alias("total"), F.min("distance").alias("nearest"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("votes"), "total", "label"))
    place = each.withColumn("place", order)
    made = place.groupBy("query_id").agg(F.max(F.when(F.col("place") == 1, F.col("label"))).alias("candidate"), F.max(F.when(F.col("place") == 1, F.col("votes"))).alias("votes"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("votes"))), F.lit(0)).alias("second"), F.sum("votes").alias("k"), F.min("nearest").alias("nearest_distance"))
    return made.select("query_id", "candidate", "votes", (F.col("votes") / F.col("k")).alias("vote_share"), ((F.col("votes") - F.col("second")) / F.col("k")).alias("vote_margin"), "nearest_distance")


@dataclass(frozen=True)
class Policy:
    """When to abstain: distance beyond, too few training rows of the class, margin at or below."""

    distance: float
    margin: float
    least_class: int


def abstention(policy: Policy, distance: Column, class_count: Column, margin: Column) -> Column:
    """The first reason that applies, in this order, or null."""
    return F.when(distance > policy.distance, "distance").when(class_count < policy.least_class, "class_count").when(margin <= policy.margin, "vote_margin")


def support_score(share: Column, distance: Column, threshold: float) -> Column:
    """share / (1 + distance / threshold) at 12 places; for threshold 0 the share at distance 0, else 0."""
    if threshold == 0:
        return F.round(F.when(distance == 0, share).otherwise(0.0), 12)
    return F.round(share / (1 + distance / threshold), 12)


def element(df: DataFrame, column: str, q: float, up: bool) -> float | None:
    """The order statistic at ceil or floor of (n - 1) q; counts of distinct values are what moves."""
    from .profile import order_statistic

    return order_statistic(df, column, q, "higher" if up else "lower").first()["value"]


def fit_policy(calibration: DataFrame, distance_quantile: float = 0.95, margin_quantile: float = 0.10, least_class: int = 5) -> Policy:
    """From voted calibration rows. A margin of 1 would never be exceeded, so the largest double below it is taken."""
    margin = element(calibration, "vote_margin", margin_quantile, False)
    return Policy(element(calibration, "nearest_distance", distance_quantile, True), 0.9999999999999999 if margin == 1.0 else margin, least_class)


def label_table(df: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct labels with dense codes from 0."""
    return df.select(label).distinct().withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)


def parity(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One row: keys on one side only, refs that differ, distances beyond the tolerance."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    one_sided = F.col(f"a.{keys[0]}").isNull() | F.col(f"b.{keys[0]}").isNull()
    return joined.agg(F.count_if(one_sided).alias("one_sided"), F.count_if(~one_sided & (F.col("a.ref") != F.col("b.ref"))).alias("different_refs"), F.count_if(~one_sided & (F.abs(F.col("a.distance") - F.col("b.distance")) > tolerance)).alias("beyond_tolerance"))


def stored_parity(model: DataFrame, index: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """One row over all vectors: ids that do not stand exactly once on each side (so the counts are equal if it is 0), labels that differ, vectors that differ in length, a null or beyond the tolerance in any place.

    model and index: (key, label, v). A value that is not a number counts as beyond."""
    n = F.count(F.lit(1)).alias("n")
    # An id that is there more than once is a fault whatever it holds, so any one of its rows will do.
    one = lambda df: df.groupBy(key).agg(n, F.first(F.struct("label", "v")).alias("e"))
    a, b = one(model).alias("a"), one(index).alias("b")
    joined = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    once = F.col(f"a.{key}").isNotNull() & F.col("a.n").eqNullSafe(F.lit(1)) & F.col("b.n").eqNullSafe(F.lit(1))
    v, w = F.col("a.e.v"), F.col("b.e.v")
    near = (F.size(v) == F.size(w)) & F.forall(F.zip_with(v, w, lambda x, y: F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))), lambda x: x)
    return joined.agg(F.count_if(~once).alias("one_sided"), F.count_if(once & ~F.col("a.e.label").eqNullSafe(F.col("b.e.label"))).alias("different_labels"), F.count_if(once & ~F.coalesce(near, F.lit(False))).alias("beyond_tolerance"))
