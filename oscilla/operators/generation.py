"""What goes to a text generator and what may come back: evidence envelopes, validation of outputs, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strict_json import canonical_json

#: Contract, envelope, limits, codes.
CONTRACT = "prescriptive-generation.v1"
MARK = "UNTRUSTED_DOCUMENT_"
MOST_OUTPUT, MOST_NARRATIVE, MOST_SHORT = 64_000, 4_000, 512
IDENTIFIER = "^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
LIMITATIONS = ("evidence_gap", "evidence_conflict")
_CITED = "citations: array<struct<evidence_id: string>>"
OUTPUT = (
    f"schema_version string, diagnostic_support struct<fault_code: string, status: string, assessment: string, {_CITED}>, "
    f"prescriptions array<struct<action: string, rationale: string, {_CITED}>>, warnings array<struct<code: string, message: string, {_CITED}>>"
)


def sentinels(evidence_id: Column, content: Column) -> Column:
    """struct(begin, end) around a content that holds neither: the smallest number whose marks don't occur in it."""
    stem = F.concat(F.lit(MARK), F.sha2(evidence_id, 256), F.lit("_"))
    taken = F.array_distinct(F.regexp_extract_all(content, F.concat(stem, F.lit("(0|[1-9][0-9]{0,8})_(?:BEGIN|END)")), F.lit(1)))
    free = F.array_min(F.array_except(F.transform(F.sequence(F.lit(0), F.size(taken)), lambda i: i.cast("string")), taken).cast("array<int>"))
    mark = F.concat(stem, free.cast("string"))
    return F.struct(F.concat(mark, F.lit("_BEGIN")).alias("begin_sentinel"), F.concat(mark, F.lit("_END")).alias("end_sentinel"))


def enveloped(evidence: DataFrame) -> DataFrame:
    """evidence (evidence_id, content, ...) with content_sha256 and sentinels."""
    return evidence.withColumn("content_sha256", F.sha2("content", 256)).withColumn("s", sentinels(F.col("evidence_id"), F.col("content"))).select("*", "s.*").drop("s")


def requests(evidence: DataFrame, by: str) -> DataFrame:
    """(by, evidence_ids, input_json): the envelopes of each group in the order of their ids as one JSON text with sorted keys.

    evidence: (by, evidence_id, source_id, locator, content), within the budget of items that retrieval.budget keeps, so a group is small."""
    document = F.struct("begin_sentinel", "content", "content_sha256", F.lit("utf-8-json-string").alias("encoding"), "end_sentinel", F.lit("untrusted").alias("trust"))
    item = F.struct("evidence_id", "locator", "source_id", document.alias("untrusted_document"))
    made = enveloped(evidence).groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    return made.select(by, F.col("evidence.evidence_id").alias("evidence_ids"), F.to_json(F.struct(F.lit(CONTRACT).alias("contract_version"), "evidence")).alias("input_json"))


def _text(c: Column, most: int) -> Column:
    return F.coalesce((F.length(c) <= most) & c.rlike(r"\S"), F.lit(False))


def _cited(c: Column, least: int) -> Column:
    ids = F.coalesce(c["evidence_id"], F.array().cast("array<string>"))
    return (F.size(ids) >= least) & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, lambda i: F.coalesce(i.rlike(IDENTIFIER), F.lit(False)))


def output_problem(text: Column, allowed: Column, fault: Column) -> Column:
    """Why an output must not be used: malformed, contract, other_fault, unknown_citation; null if it may.

    The text is read by the schema and written again; if that isn't the same value, it had other keys or other types."""
    o = F.from_json(text, OUTPUT)
    support, given = o["diagnostic_support"], canonical_json(text)
    again = canonical_json(F.to_json(o))
    unassessed = F.lit('"diagnostic_support":{"assessment":null,')
    same = F.replace(given, unassessed, F.lit('"diagnostic_support":{')) == again
    complete = o["prescriptions"].isNotNull() & o["warnings"].isNotNull() & (support["assessment"].isNotNull() | F.contains(given, unassessed))
    limited = F.exists(o["warnings"], lambda w: w["code"].isin(*LIMITATIONS))
    none = F.array().cast("array<struct<evidence_id:string>>")
    cited = F.coalesce(support["citations"], none)
    supported = _text(support["assessment"], MOST_NARRATIVE) & (F.size(cited) > 0) & (F.size(o["prescriptions"]) > 0) & ~limited
    insufficient = support["assessment"].isNull() & (F.size(cited) == 0) & (F.size(o["prescriptions"]) == 0) & limited
    shape = F.when(support["status"] == "supported", supported).when(support["status"] == "insufficient_evidence", insufficient).otherwise(False)
    sound = (
        (o["schema_version"] == CONTRACT) & support["fault_code"].rlike(IDENTIFIER) & _cited(support["citations"], 0) & shape
        & F.forall(o["prescriptions"], lambda p: _text(p["action"], MOST_NARRATIVE) & _text(p["rationale"], MOST_NARRATIVE) & _cited(p["citations"], 1))
        & F.forall(o["warnings"], lambda w: F.coalesce(w["code"].rlike(IDENTIFIER), F.lit(False)) & _text(w["message"], MOST_SHORT) & _cited(w["citations"], 0))
    )
    every = F.flatten(F.array(cited["evidence_id"], *(F.flatten(F.transform(o[part], lambda x: F.coalesce(x["citations"], none)["evidence_id"])) for part in ("prescriptions", "warnings"))))
    readable = F.coalesce((F.length(text) <= MOST_OUTPUT) & given.isNotNull(), F.lit(False))
    return (
        F.when(~readable, "malformed").when(~F.coalesce(same & complete & sound, F.lit(False)), "contract")
        .when(~F.coalesce(support["fault_code"] == fault, F.lit(False)), "other_fault")
        .when(F.size(F.array_except(every, F.coalesce(allowed, F.array().cast("array<string>")))) > 0, "unknown_citation")
    )


def priorities(diagnoses: DataFrame, policy: DataFrame, key: str) -> DataFrame:
    """diagnoses with `priority` of exactly their fault code; null without a rule, never another rule's. policy: (key, priority), reviewed by hand and so small; a repeated code raises."""
    rules = policy.groupBy(key).agg(F.when(F.count(F.lit(1)) == 1, F.min("priority")).otherwise(F.raise_error(F.lit("a fault code has two rules")).cast("string")).alias("priority"))
    return diagnoses.join(rules, key, "left")
