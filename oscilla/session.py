"""The session that the engine expects: UTC, adaptive execution, ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints that nothing refers to are removed from the shared folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "oscilla", **more: str) -> SparkSession:
    """A session with CONF; `more` adds or overrides, with dots written as double underscores."""
    conf = CONF | {k.replace("__", "."): v for k, v in more.items()}
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()
