"""Streams over files of events: gap sessions, repeated ids, scoring, illegal life-cycle steps. Sessions with timers are in stateful.py."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import lifecycle, neighbours


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet files. Timestamps without zone are read as UTC."""
    return spark.readStream.schema(schema).parquet(path)


def gap_sessions(events: DataFrame, gap: str, watermark: str, at: str = "ts") -> DataFrame:
    """Sessions that end when the watermark has passed them; a gap equal to the duration still joins, as in batch."""
    one = F.floor(F.year(at) / 10000).alias("stream")  # session windows need a key besides, and no literal
    return events.withWatermark(at, watermark).groupBy(F.session_window(at, gap).alias("w"), one).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("start_at"), F.max(at).alias("end_at")).drop("w", "stream")


def distinct_ids(events: DataFrame, key: str, watermark: str, at: str = "ts") -> DataFrame:
    """The first row of each id within the watermark; batch flags all repeated rows instead."""
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])


def score(queries: DataFrame, train: DataFrame, path: str, k: int = neighbours.TOP_K):
    """A started query that ranks each micro-batch of (query_id, v) by the batch operator and appends to path; a batch that runs again replaces its own folder."""
    rows = train.count()

    def one(batch: DataFrame, number: int) -> None:
        neighbours.ranked(batch, train, k, rows=rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()


def lifecycle_problems(events: DataFrame, key: str) -> DataFrame:
    """Steps that the transition matrix does not allow from the state so far. events: (key, sequence, target_status), in order within a key."""
    allowed = {(a, b) for a, targets in lifecycle.TRANSITIONS.items() for b in targets}

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else None
        bad = []
        for sequence, target in pd.concat(list(frames)).sort_values("sequence")[["sequence", "target_status"]].itertuples(index=False):
            if (status is None and target != "received") or (status is not None and (status, target) not in allowed):
                bad.append((k[0], sequence, status, target))
            status = target
        state.update((status,))
        yield pd.DataFrame(bad, columns=[key, "sequence", "source_status", "target_status"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, sequence long, source_status string, target_status string", "status string", "append", GroupStateTimeout.NoTimeout)


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there and gives its rows, which go to Parquet files in the shared folder."""
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="oscilla-stream-")
    path = f"{root.rstrip('/')}/{name}"
    query = stream.writeStream.outputMode("append").format("parquet").queryName(name).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
