"""Decision tables: guardrail refusals, orchestration, public outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guardrail(d: dict[str, Column]) -> Column:
    """The first refusal that applies, or null. d: diagnosis_ok, retrieval_ok, retrieval_status, same_fault, items, blank, unsafe, duplicate_ids, current (null: can't be told), provider."""
    return (
        F.when(~d["diagnosis_ok"], "invalid_diagnosis")
        .when(~d["retrieval_ok"], "invalid_retrieval")
        .when(d["retrieval_status"].isin("no_evidence", "unmapped_fault", "retrieval_unavailable"), d["retrieval_status"])
        .when((d["retrieval_status"] != "evidence") | ~d["same_fault"], "diagnosis_conflict")
        .when(d["items"] == 0, "no_evidence")
        .when(d["blank"] | d["unsafe"], "unsafe_evidence")
        .when(d["duplicate_ids"], "evidence_conflict")
        .when(d["current"].isNull(), "currentness_unavailable")
        .when(~d["current"], "stale_evidence")
        .when(d["provider"] == "failed", "provider_error")
        .when(d["provider"] == "invalid_response", "invalid_provider_output")
    )


def orchestration(d: dict[str, Column]) -> Column:
    """struct(status, reason). d: prediction_ok, top_k, disposition, retrieval_key, retrieval_status, refusal, provider."""
    pair = lambda s, r: F.struct(F.lit(s).alias("status"), (F.lit(r) if r else F.lit(None).cast("string")).alias("reason"))
    return (
        F.when(~d["prediction_ok"], pair("degraded", "invalid_prediction"))
        .when(~d["top_k"].between(1, 10), pair("degraded", "invalid_request"))
        .when(d["disposition"] == "normal", pair("skipped", "normal"))
        .when(d["disposition"] == "out_of_distribution", pair("skipped", "out_of_distribution"))
        .when(d["retrieval_key"].isNull(), pair("skipped", "undocumented_fault"))
        .when(d["retrieval_status"] == "no_evidence", pair("skipped", "no_evidence"))
        .when(d["retrieval_status"] == "unmapped_fault", pair("skipped", "unmapped_fault"))
        .when(d["retrieval_status"] == "retrieval_unavailable", pair("degraded", "retrieval_unavailable"))
        .when(d["provider"] == "timed_out", pair("degraded", "provider_timeout"))
        .when(d["provider"] == "busy", pair("degraded", "provider_busy"))
        .when(d["provider"] == "disabled", pair("degraded", "provider_disabled"))
        .when(d["provider"] == "failed", pair("degraded", "provider_error"))
        .when(d["refusal"].isNull(), pair("generated", None))
        .when(d["refusal"] == "currentness_unavailable", pair("degraded", "currentness_unavailable"))
        .otherwise(pair("refused", "guardrail_refusal"))
    )


def outcome(status: Column, reason: Column, projected: Column) -> Column:
    """One of five outcomes with its warning; `projected`: a prescription with a priority and citations could be made."""
    pair = lambda o, w: F.struct(F.lit(o).alias("outcome"), w.cast("string").alias("warning"))
    return (
        F.when((status == "skipped") & (reason == "normal"), pair("normal", F.lit(None)))
        .when((status == "skipped") & (reason == "out_of_distribution"), pair("out_of_distribution", F.lit("out_of_distribution")))
        .when((status == "skipped") & reason.isin("undocumented_fault", "no_evidence", "unmapped_fault"), pair("undocumented_fault", F.lit("documentation_not_found")))
        .when((status == "generated") & projected, pair("documented_fault", F.lit(None)))
        .when(status == "generated", pair("degraded", F.lit("prescription_projection_unavailable")))
        .otherwise(pair("degraded", F.coalesce(reason, F.lit("dependency_unavailable"))))
    )
