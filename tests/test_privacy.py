"""Classes of fields, the door for figures, and sinks that refuse."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from oscilla.plans import canonical, privacy
from oscilla.sources import files


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(60).select("id", F.when(F.col("id") < 40, "a").when(F.col("id") < 55, "b").when(F.col("id") < 59, "c").alias("kind"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("x"), F.lit("y").alias("y"))
    return privacy.classify(df, {"id": "record", "kind": "category", "x": "record", "y": "label"})


def test_class_follows_a_field_under_another_name(spark, rows, tmp_path):
    renamed = rows.where("id > 3").select(F.col("id").alias("n")).join(spark.range(9).withColumnRenamed("id", "n"), "n", "left")
    assert privacy.classes(renamed) == {"n": "record"}
    rows.write.parquet(str(tmp_path / "t"))
    assert privacy.classes(spark.read.parquet(str(tmp_path / "t"))) == {"id": "record", "kind": "category", "x": "record", "y": "label"}


def test_what_is_computed_is_not_let_out(rows):
    for column in (F.col("id") + 0, F.sha2(F.col("id").cast("string"), 256), F.struct("id"), F.array(F.struct("id")), F.concat("kind", F.col("id").cast("string")), F.max("id").over(Window.partitionBy("kind"))):
        with pytest.raises(privacy.Private, match="total"):
            privacy.released(rows.select(column.alias("total")))
    with pytest.raises(privacy.Private, match="total.id"):
        privacy.released(privacy.classify(rows.select(F.struct("id").alias("total")), {"total": "aggregate"}))
    assert privacy.released(rows.select("kind")).count() == 60


def test_figures(rows):
    made = privacy.released(privacy.summary(rows, ["kind"], {"mean": ("avg", "x"), "total": ("sum", "id"), "ids": ("distinct", "id")}))
    assert {r["kind"]: tuple(r)[1:] for r in made.collect()} == {"a": (40, False, 19.0, 780, 40), "b": (15, False, None, 705, 15), "c": (None, True, None, None, None), None: (None, True, None, None, None)}
    alone = privacy.summary(rows.where("id < 0"), [], {"total": ("sum", "id")}).collect()
    assert [tuple(r) for r in alone] == [(None, True, None)]
    assert privacy.summary(rows, ["kind"], {}, 1).where("suppressed").count() == 0


def test_refusals(rows):
    with pytest.raises(privacy.Private, match="no categories"):
        privacy.summary(rows, ["id"], {})
    with pytest.raises(privacy.Private, match="no categories"):
        privacy.summary(rows.withColumn("kind", F.concat("kind", F.col("id").cast("string"))), ["kind"], {})
    for figures in ({"top": ("max", "x")}, {"n": ("sum", "x")}, {"kind": ("sum", "x")}):
        with pytest.raises(ValueError):
            privacy.summary(rows, ["kind"], figures)
    with pytest.raises(ValueError):
        privacy.classify(rows, {"id": "secret"})
    with pytest.raises(ValueError):
        privacy.classify(rows, {"nothing": "record"})


def test_sinks_refuse_and_write_nothing(rows, tmp_path):
    planted = rows.select("kind", F.col("x").alias("n"))
    for sink in (lambda p: canonical.save_report(planted, p), lambda p: files.write_changed(planted, p, "kind", 1000), lambda p: files.render(planted, p)):
        with pytest.raises(privacy.Private, match="'n'"):
            sink(str(tmp_path / "out"))
    with pytest.raises(privacy.Private):
        canonical.save_report(rows.select(F.expr("x + 0").alias("n")), str(tmp_path / "out"), strict=True)
    assert not list(tmp_path.iterdir())
    canonical.save_report(privacy.summary(rows, ["kind"], {"mean": ("avg", "x")}), str(tmp_path / "out"), strict=True)
