"""The event log of documents is made where a customer's orders lie."""

from __future__ import annotations

from oscilla.queries import corpus


def test_only_orders_move(spark, small):
    log = corpus.governed_log(spark, small, False)
    for df in (log, log.groupBy("document").count()):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
