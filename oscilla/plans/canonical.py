"""The canonical dataset: contract, ledger, split, fences, targets, gates, publication; and its read-only check."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import instants
from ..operators import contract, ordering, quality, sessions, split
from ..shared import cut
from ..sources import files
from ..sources.readings import FEATURES, SCHEMA
from .privacy import PRIVATE, released

#: Columns that must never be features.
DENIED = ("id", "created_at", "fault", "record_id", "source_position", "occurrence_id", "partition", "disposition", "y")


def private_fields(df: DataFrame) -> list[str]:
    """Fields that carry a forbidden class in their metadata, or none at all."""
    return [f.name for f in df.schema if f.metadata.get("privacy", "record") in PRIVATE]


def policy_problems(rules: tuple = quality.RULES) -> list[str]:
    """What is wrong with a rule table: repeated ids or precedences, unknown actions or reasons."""
    ids, order = [r[0] for r in rules], [r[3] for r in rules]
    out = ["repeated rule"] * (len(set(ids)) < len(ids)) + ["repeated precedence"] * (len(set(order)) < len(order))
    return out + [f"unknown action of {r[0]}" for r in rules if r[2] not in dict(quality.ACTIONS)] + [f"unknown reason of {r[0]}" for r in rules if r[1] not in quality.REASONS]


def numbered(df: DataFrame) -> DataFrame:
    """Adds the instant in microseconds, source_position (1..n in time order) and record_id."""
    at = instants.parse(F.col("created_at"))
    rows = df.withColumn("at", at["sec"] * 1_000_000 + (at["frac"] * 1_000_000).cast("long")).withColumn("tie", F.xxhash64(*df.columns))
    placed = ordering.running_sum(ordering.stretched(rows, "at", "tie"), F.lit(1), "source_position", "at", "tie").drop("stretch", "tie")
    return placed.withColumn("record_id", F.sha2(F.concat_ws(":", F.col("source_position").cast("string"), F.col("id").cast("string"), "created_at"), 256))


def assembled(df: DataFrame, labels: dict[str, str], limit: int = sessions.DAY) -> tuple[dict[str, DataFrame], float]:
    """The tables (canonical, dispositions, train, validation, test) and the fitted gap threshold. df must meet the contract."""
    if found := contract.report(df.select(*SCHEMA.names)).collect():
        raise ValueError(f"the contract is broken: {found}")
    if problems := policy_problems():
        raise ValueError(f"the policy is broken: {problems}")
    ledger = cut(quality.resolve(quality.matches(numbered(df.select(*SCHEMA.names)))))
    rows = ledger.where("disposition <> 'rejected'").select("at", F.col("source_position").alias("position"))
    threshold, found = split.fixed_point(rows, limit)
    placed = split.sessioned(rows, threshold, limit).join(found.select("session", "partition", "exclusion"), "session").select(F.col("position").alias("source_position"), "session", "partition", "exclusion")
    eligible = ledger.join(placed, "source_position")
    fences = quality.fences(eligible.where("partition = 'train'"))
    # Targets come in after the split: a label can't have steered it.
    slugs = F.create_map(*(F.lit(x) for item in sorted(labels.items()) for x in item))
    flagged = cut(quality.resolve(quality.flag_outliers(eligible, fences)).withColumn("y", F.coalesce(F.try_element_at(slugs, F.col("fault")), F.raise_error(F.lit("a label has no slug")).cast("string"))))
    canonical = flagged.select("record_id", "source_position", F.col("id").alias("source_id"), instants.canonical(instants.parse(F.col("created_at"))).alias("event_timestamp_utc"), "y", F.concat(F.lit("occurrence_"), F.sha2(F.col("session").cast("string"), 256)).alias("occurrence_id"), "partition", F.col("exclusion").alias("split_exclusion_reason"), *FEATURES)
    rejected = ledger.where("disposition = 'rejected'").select("record_id", "source_position", "disposition", "reason_codes", "rules", F.lit("rejected").alias("dataset_destination"))
    dispositions = flagged.select("record_id", "source_position", "disposition", "reason_codes", "rules", F.coalesce("partition", "exclusion").alias("dataset_destination")).unionByName(rejected)
    parts = {p: canonical.where(F.col("partition") == p).select(*FEATURES, "y") for p in ("train", "validation", "test")}
    return {"canonical": canonical, "dispositions": dispositions, **parts}, threshold


def gates(tables: dict[str, DataFrame], source_rows: int, threshold: float) -> DataFrame:
    """(gate, passed): coverage, alignment, disjointness, order, purge gap, features, emptiness, the fit made anew; each one aggregate over published tables."""
    c, d = tables["canonical"], tables["dispositions"]
    at = instants.parse(F.col("event_timestamp_utc"))
    c = c.withColumn("at", at["sec"] * 1_000_000 + (at["frac"] * 1_000_000).cast("long"))
    ledger = d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_position").alias("positions"), F.countDistinct("record_id").alias("ids"), F.bool_and((F.col("disposition") == "rejected") == (F.col("dataset_destination") == "rejected")).alias("aligned")).first()
    both = d.where("dataset_destination <> 'rejected'").join(c.select("record_id", F.coalesce("partition", "split_exclusion_reason").alias("own")), "record_id", "full_outer").agg(F.count_if(F.col("own").isNull() | F.col("dataset_destination").isNull()).alias("one_sided"), F.count_if(F.col("own") != F.col("dataset_destination")).alias("moved")).first()
    mixed = c.groupBy("occurrence_id").agg(F.countDistinct(F.coalesce("partition", "split_exclusion_reason")).alias("k")).where("k > 1").limit(1).count()
    ends = {r["partition"]: r for r in c.where("partition is not null").groupBy("partition").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count(F.lit(1)).alias("n")).collect()}
    whole = {"train", "validation", "test"} <= set(ends)
    gap = lambda a, b: ends[b]["low"] - ends[a]["high"]
    # The names are fixed values.
    rows = [
        ("ledger.complete_destination", ledger["n"] == source_rows == ledger["positions"] == ledger["ids"] and ledger["aligned"]), ("canonical.eligible_coverage", both["one_sided"] == 0), ("partitions.assignment_alignment", both["moved"] == 0), ("partitions.occurrence_disjoint", mixed == 0),
        ("partitions.projection_exact", all(tables[p].exceptAll(c.where(F.col("partition") == p).select(*FEATURES, "y")).isEmpty() and tables[p].count() == ends[p]["n"] for p in ends)), ("partitions.temporal_order", whole and gap("train", "validation") > 0 and gap("validation", "test") > 0),
        ("partitions.purge_gap", whole and min(gap("train", "validation"), gap("validation", "test")) >= threshold), ("features.inference_only", all(t.columns == [*FEATURES, "y"] and not set(FEATURES) & set(DENIED) for n, t in tables.items() if n in ends)), ("partitions.nonempty", whole),
        ("fit.statistics_train_only", whole and split.fit_threshold(c.where("partition = 'train'").select("at", F.col("source_position").alias("position"))) == threshold),
        ("fit.target_independent", "y" not in FEATURES and not set(FEATURES) & set(DENIED)),
    ]
    return c.sparkSession.createDataFrame(rows, "gate string, passed boolean")


def build(df: DataFrame, labels: dict[str, str], path: str, digest: str, limit: int = sessions.DAY) -> tuple[bool, float]:
    """Publishes the dataset at path, once; gates are checked before. Returns whether anything was written, and the threshold."""
    tables, threshold = assembled(df, labels, limit)
    if failed := [r["gate"] for r in gates(tables, df.count(), threshold).where("not passed").collect()]:
        raise ValueError(f"gates failed: {failed}")
    return files.publish(df.sparkSession, tables, path, digest), threshold


def check(spark: SparkSession, path: str, source_rows: int, threshold: float) -> DataFrame:
    """The gates again, from what is published."""
    return gates({n: spark.read.parquet(f"{path}/{n}") for n in ("canonical", "dispositions", "train", "validation", "test")}, source_rows, threshold)


def twice(make) -> str:
    """The text of a report that comes out the same from two independent runs; another result raises."""
    first, second = make(), make()
    if first != second:
        raise ValueError("two runs differ")
    return first


def save_report(df: DataFrame, path: str, strict: bool = False) -> None:
    """JSON lines; an existing report is never overwritten. Fields of single records are refused, and unclassified ones too if `strict`."""
    released(df, strict).coalesce(1).write.mode("errorifexists").json(path)


def manifest_of(tables: dict[str, DataFrame]) -> str:
    """Rows and an order-free digest of each table, as canonical JSON."""
    out = {n: {"rows": r["n"], "digest": str(r["h"])} for n, t in sorted(tables.items()) for r in [t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)")).alias("h")).first()]}
    return json.dumps(out, sort_keys=True, separators=(",", ":"))
