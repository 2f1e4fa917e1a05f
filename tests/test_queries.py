"""Every registered query runs over the smallest tables; those with SQL give what DuckDB gives."""

from __future__ import annotations

import pytest

from oscilla import registry

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, small, con, name):
    same(registry.QUERIES[name](spark, small), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_covers_names_nothing_left_out():
    left_out = {"SRC-7", "SRC-10", "SRC-11", "MG-1", "KN-15", "UX-8", "UX-9"}
    assert not left_out & {i for ids in registry.COVERS.values() for i in ids.split()}
