"""Units of work: snapshots, conflicts of two writers, rollback, several tables at once, compare and swap."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from oscilla.sources import commits


@pytest.fixture
def store(spark, tmp_path):
    made = commits.Store(spark, f"file://{tmp_path}/store")
    with made.unit() as unit:
        unit.upsert("a", spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), ["k"])
        unit.upsert("b", spark.createDataFrame([(1, 0)], "k int, n long"), ["k"])
        assert unit.commit() == 1
    return made


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_writers_and_a_reader_between_them(spark, store):
    meet = Barrier(2)

    def write(v):
        unit = store.unit()
        unit.upsert("a", spark.createDataFrame([(1, v)], "k int, v string"), ["k"])
        unit.upsert("b", spark.createDataFrame([(1, ord(v))], "k int, n long"), ["k"])
        meet.wait()
        try:
            return unit.commit()
        except commits.Conflict:
            return None

    before = store.read("a"), store.generation()
    with ThreadPoolExecutor(2) as pool:
        first, second = pool.submit(write, "p"), pool.submit(write, "q")
        results = [first.result(), second.result()]
    assert sorted(results, key=str) == [2, None] and store.generation() == 2
    winner = "p" if results[0] else "q"
    # Both tables are the winner's; the reader keeps its generation.
    assert rows(store.read("a")) == [(1, winner), (2, "y")] and rows(store.read("b")) == [(1, ord(winner))]
    assert rows(before[0]) == [(1, "x"), (2, "y")] and rows(store.read("a", before[1])) == [(1, "x"), (2, "y")]
    assert store.sweep() == 2


def test_rollback_and_own_changes(spark, store):
    with store.unit() as unit:
        unit.upsert("a", spark.createDataFrame([(3, "z")], "k int, v string"), ["k"])
        unit.upsert("a", spark.createDataFrame([(3, "w"), (2, None)], "k int, v string"), ["k"], F.col("v").isNull())
        assert rows(unit.read("a")) == [(1, "x"), (3, "w")]
    with pytest.raises(RuntimeError):
        unit.commit()
    assert store.generation() == 1 and rows(store.read("a")) == [(1, "x"), (2, "y")] and store.sweep() == 2
    with store.unit() as unit:
        assert unit.commit() == 1
    with store.unit() as unit, pytest.raises(ValueError):
        unit.upsert("a", spark.createDataFrame([(3, 1)], "k int, other int"), ["k"])


def test_compacted_table_is_the_same(spark, store):
    for v in "rst":
        with store.unit() as unit:
            unit.upsert("a", spark.createDataFrame([(2, v)], "k int, v string"), ["k"])
            unit.commit()
    with store.unit() as unit:
        unit.compact("a")
        generation = unit.commit()
    assert len(store.entry(generation)["a"]["parts"]) == 1 and rows(store.read("a")) == [(1, "x"), (2, "t")] and rows(store.read("a", 2)) == [(1, "x"), (2, "r")]


def test_compare_and_swap(spark, store):
    def commands(*own):
        return spark.createDataFrame(own, "k int, v string, expected long, command long")

    def apply(*own):
        with store.unit() as unit:
            out = rows(commits.swap(unit, "registry", ["k"], commands(*own)))
            unit.commit()
        return out

    assert apply((1, "a", 0, 1), (1, "b", 1, 2), (2, "c", 5, 3)) == [(1, 1, "applied"), (1, 2, "behind"), (2, 3, "stale")]
    assert apply((1, "d", 0, 4), (2, "e", 0, 5)) == [(1, 4, "stale"), (2, 5, "applied")]
    assert apply((1, "f", 1, 6)) == [(1, 6, "applied")]
    assert rows(store.read("registry")) == [(1, "f", 2), (2, "e", 1)]
