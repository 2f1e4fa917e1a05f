"""Whole jobs on derived readings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from oscilla.operators import neighbours, profile
from oscilla.plans import canonical, models
from oscilla.sources import readings


def test_canonical_build_and_check(spark, small, tmp_path):
    df = readings.derived(spark, small).drop("ts").persist()
    labels = {r["fault"]: r["fault"].lower() for r in df.select("fault").distinct().collect()}
    path = str(tmp_path / "dataset")
    written, threshold = canonical.build(df, labels, path, "v1")
    assert written and canonical.check(spark, path, df.count(), threshold).where("not passed").isEmpty()
    d = spark.read.parquet(f"{path}/dispositions")
    assert d.count() == df.count() and d.where("disposition = 'rejected'").count() > 0
    spark.read.parquet(f"{path}/canonical").where("partition <> 'test' or partition is null").write.parquet(f"{path}/canonical2")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("dispositions", "train", "validation", "test")} | {"canonical": spark.read.parquet(f"{path}/canonical2")}
    assert {r["gate"] for r in canonical.gates(tables, df.count(), threshold).where("not passed").collect()} >= {"canonical.eligible_coverage", "partitions.nonempty"}
    with pytest.raises(ValueError, match="contract"):
        canonical.assembled(df.withColumn("rpm", F.lit(None).cast("double")), labels)


def test_model_store(spark, tmp_path):
    train = spark.createDataFrame([(i, i % 2, [float(i), float(i * i % 7)]) for i in range(30)], "ref long, label int, v array<double>")
    tables, policy = models.fit(train, train.select(F.col("ref").alias("query_id"), "v"), 3)
    path = str(tmp_path / "model")
    identity = models.save(tables, path)
    assert models.load(spark, path, identity)["policy"].first()["distance"] == policy.distance == 0.0
    with pytest.raises(ValueError):
        models.load(spark, path, "other")
    assert models.index(tables["vectors"]).schema["v"].dataType.simpleString() == "array<float>"
    requests = spark.createDataFrame([(1, [1.0, 2.0], 5), (2, [1.0], 5), (3, [1.0, float("nan")], 5), (4, [1.0, 2.0], 11)], "request_id int, v array<double>, top_k int")
    assert {r["request_id"]: r["problem"] for r in models.request_problems(requests, 2).collect()} == {2: "dimension", 3: "not_finite", 4: "top_k"}
    assert neighbours.label_table(train).count() == 2


def test_reports(spark, small, tmp_path):
    df = profile.volume(spark.read.parquet(f"{small}/region.parquet"))
    assert canonical.twice(lambda: canonical.manifest_of({"a": df})) == canonical.manifest_of({"a": df})
    canonical.save_report(df, str(tmp_path / "r"))
    with pytest.raises(Exception, match="exists"):
        canonical.save_report(df, str(tmp_path / "r"))
    assert canonical.private_fields(df) == ["row_count", "column_count"]
    safe = df.select(F.col("row_count").alias("row_count", metadata={"privacy": "count"}))
    assert canonical.private_fields(safe) == [] and canonical.policy_problems() == []
    assert canonical.policy_problems((("x", "y", "z", 1), ("x", "iqr_outlier", "flag", 1))) == ["repeated rule", "repeated precedence", "unknown action of x", "unknown reason of x"]


def test_frozen_plan(spark):
    train = spark.createDataFrame([(i, i % 2, [float(i), float(i * i % 7)]) for i in range(30)], "ref long, label int, v array<double>")
    validation, test = train.where("ref < 9"), train.where("ref > 20")
    tables, _ = models.fit(train, validation.select(F.col("ref").alias("query_id"), "v"), 3)
    dataset, identity, stored = {"train": train, "validation": validation, "test": test}, canonical.manifest_of(tables), models.index(tables["vectors"])
    name, plan = models.frozen_plan(dataset, tables, identity, stored, "validation")
    assert models.frozen_plan(dataset, tables, identity, stored, "validation") == (name, plan)
    assert models.frozen_plan(dataset | {"test": train.where("ref > 21")}, tables, identity, stored, "validation")[0] != name
    for bad in ((dataset, tables, "{}", stored, "train"), (dataset, tables, identity, stored, "test"), (dataset, tables, identity, stored.where("label = 0"), "train"), (dataset | {"test": validation}, tables, identity, stored, "validation"), (dataset | {"train": test}, tables, identity, stored, "validation")):
        with pytest.raises(ValueError):
            models.frozen_plan(*bad)


def test_fit_of_the_train_part_is_made_anew(spark, small, tmp_path):
    df = readings.derived(spark, small).drop("ts").persist()
    labels = {r["fault"]: r["fault"].lower() for r in df.select("fault").distinct().collect()}
    tables, threshold = canonical.assembled(df, labels)
    tables = {n: canonical.cut(t) for n, t in tables.items()}
    broken = lambda t, x: {r["gate"] for r in canonical.gates(t, df.count(), x).where("not passed").collect()}
    assert canonical.gates(tables, df.count(), threshold).count() == 11 and broken(tables, threshold) == set()
    assert "fit.statistics_train_only" in broken(tables, threshold / 2)
    moved = tables["canonical"].withColumn("partition", F.when(F.col("partition") == "validation", "test").otherwise(F.col("partition")))
    assert {"partitions.assignment_alignment", "partitions.projection_exact", "partitions.nonempty", "partitions.temporal_order"} <= broken(tables | {"canonical": moved}, threshold)
    doubled = tables["dispositions"].unionByName(tables["dispositions"].limit(1))
    assert "ledger.complete_destination" in broken(tables | {"dispositions": doubled}, threshold)
    renamed = tables["train"].withColumnRenamed(tables["train"].columns[0], "created_at")
    assert "features.inference_only" in broken(tables | {"train": renamed}, threshold)
