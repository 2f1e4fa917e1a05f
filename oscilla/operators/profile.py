"""Profiles of tables: volume, completeness, numeric statistics, duplicates, labels, time, unit pairs, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite, percentage, ratio, within_tolerance
from . import quantiles, sessions

QUARTILES = (0.25, 0.5, 0.75)


def volume(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def completeness(df: DataFrame, domains: dict[str, Column] | None = None) -> DataFrame:
    """A row for each column: observed, null, NaN, infinite and out-of-domain counts, and the share observed. One aggregate, then unpivoted."""
    kinds, domains = dict(df.dtypes), domains or {}
    made = []
    for c in df.columns:
        col, real = F.col(f"`{c}`"), kinds[c] in ("double", "float")
        nan = F.isnan(col) if real else F.lit(False)
        inf = F.abs(col) == float("inf") if real else F.lit(False)
        ok = domains.get(c, F.lit(True))
        made.append(F.struct(F.lit(c).alias("column_name"), F.count_if(col.isNotNull() & ~nan).alias("observed"), F.count_if(col.isNull()).alias("nulls"), F.count_if(nan).alias("nans"), F.count_if(F.coalesce(inf, F.lit(False))).alias("infinities"), F.count_if(col.isNotNull() & ~nan & ~F.coalesce(ok, F.lit(True))).alias("outside_domain")))
    one = df.agg(F.count(F.lit(1)).alias("n"), F.array(*made).alias("rows"))
    return one.select("n", F.explode("rows").alias("r")).select("r.*", percentage(F.col("r.observed"), F.col("n")).alias("observed_percent"))


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column, over finite values: count, extremes, mean, population deviation, type-7 quartiles, fences at 1.5 IQR, values strictly outside.

    One pass for the statistics, three for the quartiles, one for the outliers against fences that are one row a column."""
    def over(c: str) -> Column:
        x = F.when(finite(F.col(c)), F.col(c).cast("double"))
        return F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"))

    stats = df.agg(F.array(*(over(c) for c in columns)).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    q = quantiles.interpolated(df, {c: F.col(c) for c in columns}, QUARTILES).select("column_name", *(F.get("values", F.lit(i)).alias(n) for i, n in enumerate(("q25", "median", "q75"))))
    stats = stats.join(F.broadcast(q), "column_name")
    stats = stats.withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("lower_fence", F.col("q25") - 1.5 * F.col("iqr")).withColumn("upper_fence", F.col("q75") + 1.5 * F.col("iqr"))
    fences = F.broadcast(stats.agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("lower_fence", "upper_fence")))).alias("fences")))
    outside = df.crossJoin(fences).agg(F.array(*(F.struct(F.lit(c).alias("column_name"), F.count_if(finite(F.col(c)) & ((F.col(c) < F.col("fences")[c]["lower_fence"]) | (F.col(c) > F.col("fences")[c]["upper_fence"]))).alias("outliers")) for c in columns)).alias("rows"))
    return stats.join(F.broadcast(outside.select(F.explode("rows").alias("r")).select("r.*")), "column_name")


def row_duplicates(df: DataFrame) -> DataFrame:
    """Groups of equal rows and rows beyond the first of each; nulls and NaNs are equal to themselves."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("excess_rows"))


def key_duplicates(df: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """Incomplete keys, repeated keys, rows beyond the first, and keys whose rows differ in any column that is not ignored."""
    rest = [c for c in df.columns if c not in ignore]
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    rows = df.groupBy(*keys, F.struct(*rest).alias("whole_row")).agg(F.count(F.lit(1)).alias("same"))
    groups = rows.groupBy(*keys).agg(F.sum("same").alias("n"), F.count(F.lit(1)).alias("distinct_rows"))
    return groups.agg(
        F.coalesce(F.sum(F.when(~whole, F.col("n"))), F.lit(0)).alias("incomplete_keys"), F.count_if(whole & (F.col("n") > 1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(whole & (F.col("n") > 1), F.col("n") - 1)), F.lit(0)).alias("excess_rows"), F.count_if(whole & (F.col("n") > 1) & (F.col("distinct_rows") > 1)).alias("conflicting_keys"),
    )


def label_distribution(df: DataFrame, label: str, allowed: list[str]) -> DataFrame:
    """Counts of allowed labels, zero-filled, and of others under an ordinal by falling count, so that no unapproved text leaves."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    known = df.sparkSession.createDataFrame([(a,) for a in allowed], "label string")
    ours = F.broadcast(known).join(counts, "label", "left").select("label", F.lit(True).alias("approved"), F.coalesce("n", F.lit(0)).alias("n"))
    rest = counts.join(F.broadcast(known), "label", "left_anti")
    order = F.row_number().over(Window.orderBy(F.desc("n"), "label"))
    other = rest.select(F.concat(F.lit("unapproved_"), order.cast("string")).alias("label"), F.lit(False).alias("approved"), "n")
    total = df.agg(F.count(F.col(label)).alias("total"))
    return ours.unionAll(other).crossJoin(F.broadcast(total)).select("label", "approved", "n", percentage(F.col("n"), F.col("total")).alias("percent"))


def normalized_entropy(counts: DataFrame, n: str = "n") -> DataFrame:
    """-sum p ln p / ln k over all k categories, also empty ones; 0 for one category."""
    whole = counts.agg(F.sum(n).alias("total"), F.count(F.lit(1)).alias("k"))
    p = ratio(F.col(n), F.col("total"))
    parts = counts.crossJoin(F.broadcast(whole)).agg(F.max("k").alias("categories"), F.max("total").alias("total"), F.sum(F.when(p > 0, p * F.ln(p))).alias("s"))
    return parts.select("categories", "total", F.round(F.when(F.col("categories") <= 1, 0.0).when(F.col("total") > 0, -F.col("s") / F.ln(F.col("categories").cast("double"))), 6).alias("entropy"))


def unit_pair(df: DataFrame, observed: Column, expected: Column) -> DataFrame:
    """Comparable rows, consistent ones, and the largest error."""
    both = finite(observed) & finite(expected)
    return df.agg(F.count_if(both).alias("comparable"), F.count_if(both & within_tolerance(observed, expected)).alias("consistent"), F.max(F.when(both, F.abs(observed - expected))).alias("largest_error"))


def intervals(df: DataFrame, instant: Column) -> DataFrame:
    """(at, gap) of distinct instants, whole numbers, in order; gap is null for the first."""
    rows = df.where(instant.isNotNull()).select(instant.alias("at")).distinct()
    return sessions.gaps(rows, position="at").select("at", "gap")


def nominal_cadence(df: DataFrame, instant: Column) -> DataFrame:
    """The most frequent interval between distinct instants, ties to the smallest; counts are shuffled, not rows."""
    counts = intervals(df, instant).where("gap is not null").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("gap", F.struct(-F.col("n"), F.col("gap"))).alias("cadence"), F.max("n").alias("intervals"))


def input_order(df: DataFrame, instant: Column, position: Column, width: int = 1 << 20) -> DataFrame:
    """constant, nondecreasing, nonincreasing or unordered, as the rows stand by position, a whole number.

    Rows are ordered inside stretches of `width` positions; one row a stretch carries its last instant over."""
    rows = df.where(instant.isNotNull()).select(instant.alias("at"), position.alias("position"), F.floor(position / width).alias("stretch"))
    ends = rows.groupBy("stretch").agg(F.max_by("at", "position").alias("end")).withColumn("before", F.lag("end").over(Window.orderBy("stretch"))).select("stretch", "before")
    step = F.sign(F.col("at") - F.coalesce(F.lag("at").over(Window.partitionBy("stretch").orderBy("position")), F.col("before")))
    made = rows.join(ends, "stretch").select(step.alias("step")).agg(F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(True)).alias("up"), F.coalesce(F.bool_and(F.col("step") <= 0), F.lit(True)).alias("down"))
    return made.select(F.when(F.col("up") & F.col("down"), "constant").when(F.col("up"), "nondecreasing").when(F.col("down"), "nonincreasing").otherwise("unordered").alias("input_order"))


def temporal(df: DataFrame, instant: Column) -> DataFrame:
    """Valid, invalid and distinct instants, period, nominal cadence, irregular intervals, gaps beyond twice the cadence, their sum and the largest."""
    steps = intervals(df, instant)
    cadence = F.broadcast(nominal_cadence(df, instant).select("cadence"))
    gaps = steps.crossJoin(cadence)
    beyond = F.col("gap") > 2 * F.col("cadence")
    made = gaps.agg(F.count(F.lit(1)).alias("distinct_instants"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("cadence").alias("cadence"), F.count_if(F.col("gap") != F.col("cadence")).alias("irregular"), F.count_if(beyond).alias("gaps"), F.coalesce(F.sum(F.when(beyond, F.col("gap"))), F.lit(0)).cast("long").alias("gap_total"), F.max("gap").alias("largest_gap"))
    counted = df.agg(F.count(instant).alias("valid"), F.count_if(instant.isNull()).alias("invalid"))
    return counted.crossJoin(made)


def reconciled(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(code, expected, actual, passed) for each pair of aggregates, all in one pass."""
    one = df.agg(F.array(*(F.struct(F.lit(k).alias("code"), e.cast("long").alias("expected"), a.cast("long").alias("actual")) for k, (e, a) in checks.items())).alias("rows"))
    return one.select(F.explode("rows").alias("r")).select("r.*", F.col("r.expected").eqNullSafe(F.col("r.actual")).alias("passed"))


def order_statistic(df: DataFrame, value: str, q: float, side: str) -> DataFrame:
    """The element at floor or ceil((n - 1) q) of the sorted finite values: neither interpolation nor nearest rank."""
    return quantiles.elements(df, {value: F.col(value)}, (q,)).select(F.col("low" if side == "lower" else "high").alias("value"))


def table_hash(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Rows and a SHA-256 that does not depend on their order: of the count and of eight sums, one for each 32-bit word of the rows' own SHA-256.

    Columns must be texts, integers or fixed decimals. One pass with partial sums; a changed, missing or repeated row changes all sums."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns)), 256)
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"w{i}") for i in range(8)]
    sums = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("row_count"), *words)
    return sums.select("row_count", F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), *(F.coalesce(F.col(f"w{i}").cast("string"), F.lit("0")) for i in range(8))), 256).alias("digest"))


#: The indicators of a baseline in their order, and what each one decides.
INDICATORS = (
    ("integrity.source", "blocking"),
    ("parsing.csv", "blocking"),
    ("contract.banner", "blocking"),
    ("expectation.dimensions", "blocking"),
    ("expectation.fault_cardinality", "blocking"),
    ("determinism.temporal_arithmetic", "blocking"),
    ("sanitization.public_payload", "blocking"),
    ("reconciliation.aggregate_counts", "blocking"),
    ("classification.public_fields", "blocking"),
    ("determinism.byte_equality", "blocking"),
    ("quality.complete_duplicates", "alert"),
    ("quality.repeated_ids", "alert"),
    ("quality.conflicting_ids", "alert"),
    ("quality.irregular_cadence", "alert"),
    ("quality.temporal_gaps", "alert"),
    ("quality.redundant_pairs", "alert"),
    ("observation.temporal_period", "observation"),
    ("observation.column_statistics", "observation"),
    ("observation.iqr_outliers", "observation"),
    ("observation.anonymous_fault_distribution", "observation"),
    ("observation.fault_imbalance", "observation"),
    ("observation.redundant_pair_consistency", "observation"),
)


def findings(df: DataFrame, key: str, instant: Column, label: str, required: list[str], measured: list[str], pair: tuple[Column, Column], rows: int, columns: int, labels: int) -> DataFrame:
    """One row with the count of findings for each indicator that counts any: the profile's parts, each an aggregate, side by side.

    A table that could not be read or whose source differs never gets here, so these indicators count nothing, as do those that two runs of the job decide."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    by_label = counts.agg(F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("labelled"), F.coalesce(F.max("n") - F.min("n"), F.lit(0)).alias("imbalance"))
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("with_label"), sum((F.count_if(F.col(c).isNull()) for c in required), F.lit(0)).alias("broken"))
    outliers = numeric(df, measured).agg(F.sum("outliers").alias("outliers"))
    parts = [by_label, row_duplicates(df).select("excess_rows"), key_duplicates(df, [key]).select("duplicate_keys", "conflicting_keys"), temporal(df, instant).select("valid", "irregular", "gaps"), unit_pair(df, *pair).select((F.col("comparable") - F.col("consistent")).alias("inconsistent"), "consistent"), outliers]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, whole)
    flag = lambda ok: F.when(ok, 0).otherwise(1)
    made = {
        "contract.banner": F.col("broken"), "expectation.dimensions": flag((F.col("n") == rows) & F.lit(len(df.columns) == columns)), "expectation.fault_cardinality": flag(F.col("kinds") == labels), "reconciliation.aggregate_counts": flag(F.col("labelled") == F.col("with_label")) + flag(F.col("with_label") == F.col("n")),
        "quality.complete_duplicates": F.col("excess_rows"), "quality.repeated_ids": F.col("duplicate_keys"), "quality.conflicting_ids": F.col("conflicting_keys"), "quality.irregular_cadence": F.col("irregular"), "quality.temporal_gaps": F.col("gaps"), "quality.redundant_pairs": F.col("inconsistent"),
        "observation.temporal_period": F.when(F.col("valid") > 0, 1).otherwise(0), "observation.column_statistics": F.lit(len(measured)), "observation.iqr_outliers": F.col("outliers"), "observation.anonymous_fault_distribution": F.col("kinds"), "observation.fault_imbalance": F.col("imbalance"), "observation.redundant_pair_consistency": F.col("consistent"),
    }
    return one.select(*(F.coalesce(c.cast("long"), F.lit(0)).alias(code.replace(".", "_")) for code, c in made.items()))


def indicators(found: DataFrame) -> DataFrame:
    """(code, classification, passed, finding_count, accepted) of INDICATORS from one row of findings; observations pass always, and a table is accepted if all blocking ones passed."""
    def row(code: str, kind: str) -> Column:
        name = code.replace(".", "_")
        n = F.col(name) if name in found.columns else F.lit(0).cast("long")
        return F.struct(F.lit(code).alias("code"), F.lit(kind).alias("classification"), (F.lit(kind == "observation") | (n == 0)).alias("passed"), n.alias("finding_count"))

    gates = F.array(*(row(*i) for i in INDICATORS))
    accepted = F.forall(F.filter(gates, lambda g: g["classification"] == "blocking"), lambda g: g["passed"])
    return found.select(F.explode(gates).alias("g"), accepted.alias("accepted")).select("g.*", "accepted")
