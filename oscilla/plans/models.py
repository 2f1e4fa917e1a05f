"""Nearest-neighbour models as tables: vectors, scaler, policy, and a digest that binds them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbours
from ..shared import cut
from ..sources import files
from .canonical import manifest_of


def fit(train: DataFrame, calibration: DataFrame, k: int = neighbours.TOP_K) -> tuple[dict[str, DataFrame], neighbours.Policy]:
    """Scaler on train, standard vectors, and the abstention policy from calibration rows (query_id, v).

    The scaler's row is made once: the last digits of its means depend on the order in which partial sums arrive, so made anew it
    would be another model."""
    scaler = cut(neighbours.scaler(train))
    vectors = neighbours.standardized(train, scaler)
    policy = neighbours.fit_policy(neighbours.voted(neighbours.ranked(neighbours.standardized(calibration, scaler), vectors, k)).persist())
    spark = train.sparkSession
    return {"vectors": vectors, "scaler": scaler, "policy": spark.createDataFrame([tuple(asdict(policy).values())], "distance double, margin double, least_class int")}, policy


def save(tables: dict[str, DataFrame], path: str) -> str:
    """Publishes a model once; its identity is the digest of its tables."""
    identity = manifest_of(tables)
    files.publish(next(iter(tables.values())).sparkSession, tables, path, identity)
    return identity


def load(spark: SparkSession, path: str, identity: str) -> dict[str, DataFrame]:
    """The tables of a model, if they are those of the identity; else raises before any is used."""
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("vectors", "scaler", "policy")}
    if spark.read.json(f"{path}/manifest").first()["digest"] != identity or manifest_of(tables) != identity:
        raise ValueError(f"{path} holds another model")
    return tables


def frozen_plan(dataset: dict[str, DataFrame], model: dict[str, DataFrame], identity: str, stored: DataFrame, calibration: str, k: int = neighbours.TOP_K) -> tuple[str, str]:
    """(plan id, plan as canonical JSON) that binds data, model, index and policy before the test part is read for an evaluation; raises if they don't belong together.

    dataset: train, validation, test; stored: the index of the model. Only counts and digests reach the driver."""
    parts = json.loads(manifest_of({p: dataset[p] for p in ("train", "validation", "test")}))
    if manifest_of(model) != identity:
        raise ValueError("the model isn't the one of this identity")
    if calibration not in ("train", "validation") or parts[calibration]["digest"] == parts["test"]["digest"]:
        raise ValueError("the policy depends on the test part")
    made = json.loads(manifest_of({"index": stored, "expected": index(model["vectors"])}))
    if made["index"] != made["expected"] or made["index"]["rows"] != parts["train"]["rows"]:
        raise ValueError("index, model and train part differ")
    policy = model["policy"].first().asDict()
    plan = json.dumps({"dataset": parts, "model": json.loads(identity), "index": made["index"], "calibration": calibration, "policy": policy, "top_k": k}, sort_keys=True, separators=(",", ":"))
    return f"plan_{hashlib.sha256(plan.encode()).hexdigest()[:32]}", plan


def request_problems(requests: DataFrame, dimension: int = 18) -> DataFrame:
    """(request_id, problem) of requests whose vector or top_k a model must not see."""
    v = F.col("v")
    problem = F.when(F.size(v) != dimension, "dimension").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite").when(~F.col("top_k").between(1, 10), "top_k")
    return requests.select("request_id", problem.alias("problem")).where("problem is not null")


def index(vectors: DataFrame) -> DataFrame:
    """Single-precision vectors under opaque identities, in the order of these."""
    return vectors.select(F.sha2(F.concat(F.lit("neighbour:"), F.col("ref").cast("string")), 256).alias("opaque_id"), "label", F.col("v").cast("array<float>").alias("v")).sortWithinPartitions("opaque_id")
