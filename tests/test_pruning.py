"""Pruned neighbours against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from oscilla.operators import pruning

TRAIN, QUERIES = "ref long, label int, v array<double>", "query_id long, v array<double>"


def plain(queries, train, k, exclude_self):
    out = set()
    refs, x = np.array([r for r, _, v in train if v is not None]), np.array([v for *_, v in train if v is not None])
    for q, v in queries:
        if v is None:
            continue
        d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
        order = [i for i in np.lexsort((refs, d)) if not (exclude_self and refs[i] == q)][:k]
        out |= {(q, n + 1, int(refs[i]), round(float(d[i]), 9)) for n, i in enumerate(order)}
    return out


def vectors_of(kind, n, rng):
    if kind == "clusters":
        return rng.normal(size=(20, 8))[rng.integers(0, 20, n)] * 50 + rng.normal(size=(n, 8))
    if kind == "structureless":
        return rng.normal(size=(n, 8))
    if kind == "hot":  # a third are one vector
        v = rng.normal(size=(n, 8))
        v[: n // 3] = v[0]
        return v
    return np.round(rng.normal(size=(n, 2)))  # many equal distances


@pytest.mark.parametrize("kind", ["clusters", "structureless", "hot", "ties"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_pruned_is_exact(spark, monkeypatch, kind, exclude_self):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(pruning, "BLOCK", 100)
    v = vectors_of(kind, 900, rng)
    train = [(i, i % 4, None if i % 97 == 0 else v[i].tolist()) for i in range(900)]
    queries = [(i, v[i].tolist()) for i in range(0, 900, 5)] + [(5000, None), (5001, (v[1] + 0.25).tolist())]
    found, share = pruning.nearest(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(train, TRAIN), 4, exclude_self)
    assert {(r["query_id"], r["rank"], r["ref"], round(r["distance"], 9)) for r in found.collect()} == plain(queries, train, 4, exclude_self)
    share = share.first()
    assert share["pairs"] == 181 * len([t for t in train if t[2] is not None]) and share["measured"] <= share["pairs"]
    if kind == "clusters":
        assert share["measured"] * 10 <= share["pairs"]


def test_fewer_rows_than_wanted_and_none(spark):
    queries = spark.createDataFrame([(1, [0.0]), (2, [3.0])], QUERIES)
    train = spark.createDataFrame([(1, 0, [0.0]), (7, 1, [1.0])], TRAIN)
    found, _ = pruning.nearest(queries, train, 5)
    assert sorted((r["query_id"], r["rank"], r["ref"], r["distance"]) for r in found.collect()) == [(1, 1, 1, 0.0), (1, 2, 7, 1.0), (2, 1, 7, 2.0), (2, 2, 1, 3.0)]
    found, share = pruning.nearest(queries, train.limit(0), 5)
    assert found.count() == 0 and share.first()["measured"] == 0
    assert pruning.nearest(queries.limit(0), train, 5)[0].count() == 0
