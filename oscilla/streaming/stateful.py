"""Streams with state of their own: rows wait in event-time order, timers close what is over, late rows are output.

A processor keeps what it knows of a key in RocksDB (see `conf`), handles rows in whatever files they arrive, and drops a key's
state when it is finished."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shared import folder

#: The instant that ends a stream, in microseconds.
END = 4_000_000_000_000_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def conf(spark: SparkSession) -> None:
    """What state with timers needs of a session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


#: Waiting instants of a chunk at most.
CHUNK = 1 << 18


class _Sessions(StatefulProcessor):
    """The open session, and rows that wait for the watermark, as counts by instant.

    Each call of the state is a trip to the JVM, so what waits is kept in chunks of (instant, count), and a key is asked a few times a
    batch, however many rows it has. A key has one timer."""

    def __init__(self, key: str, gap_us: int, limit_us: int) -> None:
        self.key, self.gap, self.limit = key, gap_us, limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start_at long, end_at long, n long")
        self.waiting = handle.getMapState("waiting", "chunk long", "rows binary")

    def _rows(self, key, kind: str, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key] * len(n), "kind": [kind] * len(n), "start_at": start, "end_at": end, "n": n}, copy=False)

    def _keep(self, rows: np.ndarray, first: int) -> None:
        """Puts (instant, count) rows into chunks that are numbered from `first`."""
        for i in range(0, len(rows), CHUNK):
            self.waiting.updateValue((first + i // CHUNK,), (rows[i : i + CHUNK].astype("<i8").tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        if key[0] is None:
            return
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        at = np.concatenate([frame["at"].to_numpy(np.int64) for frame in rows])
        late, at = at[at < mark], at[at >= mark]
        if len(at):
            timers = list(self.handle.listTimers())
            # A key without a timer has nothing that waits.
            self._keep(np.column_stack(np.unique(at, return_counts=True)), max((k[0] for k in self.waiting.keys()), default=-1) + 1 if timers else 0)
            wake = int(at.min()) // 1000 + 1
            if not timers or wake < min(timers):
                for old in timers:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(wake)
        if len(late):
            yield self._rows(key[0], "late", late, late, np.ones(len(late), np.int64))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        was = state = self.open.get()
        chunks = [np.frombuffer(v[0], "<i8").reshape(-1, 2) for _, v in self.waiting.iterator()]
        rows = np.concatenate(chunks) if chunks else np.empty((0, 2), np.int64)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        due = int(np.searchsorted(rows[:, 0], mark))
        closed = []
        for at, n in rows[:due].tolist():
            if state is not None and (at - state[1] > self.gap or at - state[0] >= self.limit):
                closed.append(state)
                state = None
            state = (at if state is None else state[0], at, n + (0 if state is None else state[2]))
        left = rows[due:]
        if due:
            self.waiting.clear()
            self._keep(left, 0)
        if state is not None and state[1] + self.gap < mark:
            closed.append(state)
            state = None
        if state is not None:
            self.open.update(state)
        elif was is not None:
            self.open.clear()
        wake = [int(at) for at in left[:1, 0]] + ([state[1] + self.gap] if state is not None else [])
        if wake:
            # The timer that brought this here goes by itself, and the next one is beyond the watermark, so it is another.
            self.handle.registerTimer(min(wake) // 1000 + 1)
        if closed:
            yield self._rows(key[0], "session", *np.array(closed, np.int64).T)

    def close(self) -> None:
        pass


def limited_sessions(events: DataFrame, key: str, gap_us: int, limit_us: int, watermark: str) -> DataFrame:
    """(key, kind, start_at, end_at, n): sessions by key, broken by gap or duration, once the watermark has passed them, and
    rows behind the watermark as `late`, one each. events: (key, at in microseconds).

    Rows wait until the watermark is beyond them, so they may come in any order within it. A null key is none: its rows move
    the watermark only, so that one of them, far ahead, ends all sessions (see `flushed`)."""
    conf(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    # The operator sees no event-time column, else Spark would drop late rows before it.
    rows = events.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", watermark).select(key, "at")
    return rows.groupBy(key).transformWithStateInPandas(_Sessions(key, gap_us, limit_us), f"{key} {kind}, kind string, start_at long, end_at long, n long", "append", "eventTime")


def flushed(spark: SparkSession, events: Callable[[], DataFrame], key: str, made: Callable[[DataFrame], DataFrame], late: DataFrame | None = None) -> DataFrame:
    """The rows of a stream that is ended: it runs over all that is there, then on from its progress over one row of no key, far
    beyond the others, which moves the watermark past every session. `late` rows come with that one. events gives (key, at)."""
    path = folder(spark, "flow")
    kind = f"{key} {events().schema[key].dataType.simpleString()}, at long"
    end = spark.createDataFrame([(None, END)], kind)
    end.limit(0).write.parquet(f"{path}/end")

    def run() -> None:
        rows = events().select(key, "at").unionByName(spark.readStream.schema(kind).parquet(f"{path}/end"))
        query = made(rows).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start(f"{path}/rows")
        query.awaitTermination()

    run()
    (end if late is None else end.unionByName(late.select(key, "at"))).write.mode("append").parquet(f"{path}/end")
    run()
    return spark.read.schema(made(events()).schema).parquet(f"{path}/rows")
