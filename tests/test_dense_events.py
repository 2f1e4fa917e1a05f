"""Splits of event streams so dense that they are fewer than three sessions: held against SQL, as any others."""

from __future__ import annotations

import pytest

from oscilla import registry
from oscilla.operators import split

from .oracle import connect, same

SECOND = 1_000_000
#: Starts of runs of events, which are seconds apart inside a run and hours between runs.
RUNS = {"none": [], "one": [0], "two": [0, 7200]}


@pytest.fixture(scope="module", params=sorted(RUNS))
def dense(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    instants = [s + i for s in RUNS[request.param] for i in range(50)]
    rows = spark.createDataFrame([(n, at * SECOND, n % 3) for n, at in enumerate(instants)], "event_id long, at long, user_id long")
    rows.selectExpr("event_id", "cast(timestamp_micros(at) as timestamp_ntz) as ts", "user_id").toPandas().to_parquet(f"{path}/events.parquet", index=False, coerce_timestamps="us")
    return path


def held(spark, dense, name):
    same(registry.QUERIES[name](spark, dense), connect(dense), registry.ORACLE_SQL[name])


def test_leakage_gates_of_too_few_sessions(spark, dense):
    held(spark, dense, "leakage_gates_events")


def test_purged_tail_of_too_few_sessions(spark, dense):
    held(spark, dense, "purge_tail_events")


def test_temporal_split_of_too_few_sessions(spark, dense):
    held(spark, dense, "temporal_split_events")


def test_a_fit_still_needs_three_sessions(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2)], "at long, position long")
    with pytest.raises(ValueError, match="three sessions"):
        split.fixed_point(rows, None)
