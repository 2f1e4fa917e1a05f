"""Models as tables: what is saved is what was fitted."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from oscilla.operators import neighbours
from oscilla.plans import models


def test_a_model_is_fitted_once(spark, tmp_path, monkeypatch):
    """Sums that come out otherwise each time, as partial sums of many tasks do, give one model nevertheless."""
    noise = F.udf(lambda: random.random() * 1e-9, "double").asNondeterministic()
    scaler = neighbours.scaler
    monkeypatch.setattr(neighbours, "scaler", lambda df: scaler(df).withColumn("noise", noise()).withColumn("mean", F.transform("mean", lambda x: x + F.col("noise"))).drop("noise"))
    train = spark.range(200).select(F.col("id").alias("ref"), (F.col("id") % 3).cast("int").alias("label"), F.array(F.col("id") % 3 * 10.0, F.sin("id")).alias("v"))
    asked = train.where("ref % 5 = 0").select(F.col("ref").alias("query_id"), "v")
    tables, _ = models.fit(train, asked)
    path = f"file://{tmp_path}/model"
    stored = models.load(spark, path, models.save(tables, path))
    again = neighbours.standardized(train, stored["scaler"])
    assert stored["vectors"].count() == 200 and again.exceptAll(stored["vectors"].select(*again.columns)).isEmpty()
