"""Files whose bytes depend on their rows alone."""

from __future__ import annotations

from itertools import count

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oscilla.sources import layout


def frame(spark, parts, n=1000):
    """n rows, two of them with a null key, dealt over `parts` partitions."""
    df = spark.range(n).select(F.when(F.col("id") > 1, F.col("id") * 7919 % 1009 % 50).alias("k"), F.col("id").alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    return df.repartition(parts, F.xxhash64("i", F.lit(parts)))


def test_same_bytes_from_any_partitions(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    layout.write(frame(spark, 2), a, "k", "i", 300)
    layout.write(frame(spark, 9), b, "k", "i", 300)
    assert sorted(map(tuple, layout.differing(spark, a, b).collect())) == [(i, True) for i in range(4)]
    back = spark.read.parquet(a)
    assert {r["part"]: r["count"] for r in back.groupBy("part").count().collect()} == {0: 300, 1: 300, 2: 300, 3: 100}
    assert back.drop("part").exceptAll(frame(spark, 3)).isEmpty() and back.count() == 1000
    first = [(r["k"], r["i"]) for r in spark.read.parquet(f"{a}/part=0").collect()]
    assert first == sorted(first, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) and first[:2] == [(None, 0), (None, 1)]


def test_one_changed_value_is_named_by_its_part(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    layout.write(frame(spark, 2), a, "k", "i", 300)
    last = spark.read.parquet(f"{a}/part=3").agg(F.max("i")).first()[0]
    layout.write(frame(spark, 2).withColumn("text", F.when(F.col("i") == last, "other").otherwise(F.col("text"))), b, "k", "i", 300)
    assert {r["part"] for r in layout.differing(spark, a, b).where("not equal").collect()} == {3}
    c = str(tmp_path / "c")
    layout.write(frame(spark, 2, 900), c, "k", "i", 300)
    assert 3 in {r["part"] for r in layout.differing(spark, a, c).where("not equal").collect()}


def test_publish(spark, tmp_path):
    path, run = str(tmp_path / "out"), count(1)
    assert layout.publish(spark, lambda: frame(spark, 2 + 3 * next(run)), path, "k", "i", 400).count() == 3
    with pytest.raises(FileExistsError):
        layout.publish(spark, lambda: frame(spark, 2), path, "k", "i", 400)
    other, turn = str(tmp_path / "other"), count(1)

    def unsteady():
        n = next(turn)
        return frame(spark, 2).withColumn("text", F.concat("text", F.lit(str(n))))

    with pytest.raises(ValueError, match="two runs differ"):
        layout.publish(spark, unsteady, other, "k", "i", 400)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_edges(spark, tmp_path):
    df = frame(spark, 2, 10)
    with pytest.raises(ValueError, match="identify"):
        layout.write(df.unionByName(df.limit(1)), str(tmp_path / "x"), "k", "i")
    with pytest.raises(ValueError, match="in the way"):
        layout.write(df.withColumn("part", F.lit(1)), str(tmp_path / "x"), "k", "i")
    layout.write(df.where("i < 0"), str(tmp_path / "none"), "k", "i")
    assert layout.digests(spark, str(tmp_path / "none")).count() == 0


def test_one_encoding_a_column(spark, tmp_path):
    """Executors are JVMs of their own, and the order of several encodings in a footer is that of one JVM."""
    rows = spark.range(5000).selectExpr("id", "id % 3 = 0 as b", "cast(id % 7 as int) as i", "id / 3 as d", "concat('s', id % 5) as s", "array(id, null) as l", "cast(id as decimal(30, 2)) as n", "timestamp_micros(id) as t", "if(id % 2 = 0, null, 'x') as e", "cast(null as string) as o")
    layout.write(rows, f"file://{tmp_path}/t", "id", "i", 2048)
    files = sorted((tmp_path / "t").rglob("*.parquet"))
    assert len(files) == 3
    for path in files:
        found = pq.ParquetFile(path).metadata
        assert all(len(found.row_group(g).column(c).encodings) == 1 for g in range(found.num_row_groups) for c in range(found.num_columns))
    assert spark.read.parquet(f"file://{tmp_path}/t").drop("part").exceptAll(rows).isEmpty()
