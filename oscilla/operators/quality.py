"""The quality ledger: rules that match each record, its disposition, its reasons; nothing is removed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite, within_tolerance
from ..sources.readings import CONTRACT, FEATURES, UNIT_RELATIONS
from . import quantiles

#: Fixed values: (rule, reason, action, precedence).
RULES = (
    ("required.identifier.missing", "required_value_missing", "reject", 10),
    ("required.event_timestamp.missing", "required_value_missing", "reject", 20),
    ("required.measurement.missing", "required_value_missing", "reject", 30),
    ("required.raw_label.missing", "required_value_missing", "reject", 40),
    ("measurement.non_finite", "non_finite", "reject", 50),
    ("physical.nonnegative.lower_bound", "invalid_physical_domain", "reject", 60),
    ("physical.temperature_f.absolute_zero", "invalid_physical_domain", "reject", 70),
    ("physical.temperature_c.absolute_zero", "invalid_physical_domain", "reject", 80),
    ("duplicate.conflicting.reject", "conflicting_duplicate", "reject", 90),
    ("unit.inconsistent.ambiguous", "inconsistent_redundant_unit", "reject", 100),
    ("unit.inconsistent.deterministic", "inconsistent_redundant_unit", "correct_deterministically", 110),
    ("duplicate.identical.map_identity", "identical_duplicate", "map", 120),
    ("outlier.iqr.flag", "iqr_outlier", "flag", 130),
)
#: Effective actions from the strongest, and the disposition that each leads to.
ACTIONS = (("reject", "rejected"), ("correct_deterministically", "corrected"), ("map", "mapped"), ("flag", "flagged"), ("keep", "kept"))
#: Reasons in the order in which they are listed.
REASONS = ("required_value_missing", "non_finite", "invalid_physical_domain", "conflicting_duplicate", "inconsistent_redundant_unit", "identical_duplicate", "iqr_outlier")

MEASURED = [c for c in CONTRACT if c.kind == "double"]


def row_hash(columns: list[str]) -> Column:
    """Digest of a record's fields without its label, as the build compares records. Doubles enter by their bits, so no text form matters."""
    return F.xxhash64(*columns)


def matches(df: DataFrame, trusted: tuple[str, ...] = tuple(r[1] for r in UNIT_RELATIONS)) -> DataFrame:
    """df with `rules`: ids of all non-statistical rules that a record matches.

    Duplicates are found on the key alone, with one narrow row a key joined back, so a key that many rows share is only
    counted, never gathered."""
    content = [c.name for c in CONTRACT if c.kind != "text"]
    hashed = df.withColumn("content_hash", row_hash(content))
    keys = hashed.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("content_hash").alias("low"), F.max("content_hash").alias("high")).where("copies > 1")
    joined = hashed.join(keys, "id", "left")
    zero = [c.name for c in MEASURED if c.minimum == 0.0]
    wrong = [(r, t, ~within_tolerance(F.col(o), F.col(t) * f + term) & finite(F.col(o)) & finite(F.col(t))) for r, t, o, f, term in UNIT_RELATIONS]
    any_of = lambda parts: F.exists(F.array(*parts), lambda x: x) if parts else F.lit(False)
    found = {
        "required.identifier.missing": F.col("id").isNull(),
        "required.event_timestamp.missing": F.col("created_at").isNull(),
        "required.measurement.missing": any_of([F.col(c.name).isNull() for c in MEASURED]),
        "required.raw_label.missing": F.col("fault").isNull() | (F.trim("fault") == ""),
        "measurement.non_finite": any_of([F.col(c.name).isNotNull() & ~finite(F.col(c.name)) for c in MEASURED]),
        "physical.nonnegative.lower_bound": any_of([F.coalesce(F.col(c) < 0, F.lit(False)) for c in zero]),
        "physical.temperature_f.absolute_zero": F.coalesce(F.col("temperature_f") < -459.67, F.lit(False)),
        "physical.temperature_c.absolute_zero": F.coalesce(F.col("temperature_c") < -273.15, F.lit(False)),
        "duplicate.conflicting.reject": F.coalesce(F.col("low") != F.col("high"), F.lit(False)),
        "unit.inconsistent.ambiguous": any_of([F.coalesce(w, F.lit(False)) for _, t, w in wrong if t not in trusted]),
        "unit.inconsistent.deterministic": any_of([F.coalesce(w, F.lit(False)) for _, t, w in wrong if t in trusted]),
        "duplicate.identical.map_identity": F.coalesce(F.col("low") == F.col("high"), F.lit(False)),
    }
    rules = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in found.items())))
    return joined.select(*df.columns, rules.alias("rules"))


def resolve(df: DataFrame, rules: str = "rules") -> DataFrame:
    """Adds disposition (the strongest action of all rules), ordered reasons, and the rules by precedence."""
    action, reason = {r[0]: r[2] for r in RULES}, {r[0]: r[1] for r in RULES}
    ids = F.array_sort(F.array_distinct(F.col(rules)))
    has = lambda names: F.arrays_overlap(ids, F.array(*(F.lit(n) for n in names)))
    disposition = F.lit(ACTIONS[-1][1])
    for act, made in reversed(ACTIONS[:-1]):
        disposition = F.when(has([r for r, a in action.items() if a == act]), F.lit(made)).otherwise(disposition)
    reasons = F.array_compact(F.array(*(F.when(has([k for k, v in reason.items() if v == r]), F.lit(r)) for r in REASONS)))
    ordered = F.filter(F.array(*(F.lit(r[0]) for r in sorted(RULES, key=lambda r: r[3]))), lambda r: F.array_contains(ids, r))
    return df.withColumn("disposition", disposition).withColumn("reason_codes", reasons).withColumn(rules, ordered)


def fences(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """One row: `fences`, a map from column to (low, high) at 1.5 IQR of type-7 quartiles."""
    q = quantiles.interpolated(df, {c: F.col(c) for c in columns}, (0.25, 0.75))
    low, high = F.get("values", F.lit(0)), F.get("values", F.lit(1))
    pair = F.struct((low - 1.5 * (high - low)).alias("low"), (high + 1.5 * (high - low)).alias("high"))
    return q.agg(F.map_from_entries(F.collect_list(F.struct("column_name", pair))).alias("fences"))


def flag_outliers(df: DataFrame, fitted: DataFrame, columns: list[str] = FEATURES, rules: str = "rules") -> DataFrame:
    """Adds the outlier rule to records strictly outside any fence; fences are one row, whatever the data."""
    joined = df.crossJoin(F.broadcast(fitted))
    out = F.exists(F.array(*((F.col(c) < F.col("fences")[c]["low"]) | (F.col(c) > F.col("fences")[c]["high"]) for c in columns)), lambda x: x)
    return joined.withColumn(rules, F.when(out, F.array_append(rules, F.lit("outlier.iqr.flag"))).otherwise(F.col(rules))).drop("fences")


def complete_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of a closed set of values, zero-filled."""
    known = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return F.broadcast(known).join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_ordinal(df: DataFrame, columns: list[str], position: str) -> DataFrame:
    """The how-manieth of equal rows each is, from 0."""
    return df.withColumn("duplicate_ordinal", F.row_number().over(Window.partitionBy(*columns).orderBy(position)) - 1)
