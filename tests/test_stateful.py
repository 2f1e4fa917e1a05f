"""Streams with timers: sessions in any order of arrival, late rows, the end of a stream, and what state is left."""

from __future__ import annotations

import random

from oscilla.streaming import stateful

S = 1_000_000


def plain(rows, gap, limit):
    out = []
    for key in sorted({k for k, _ in rows}):
        start = last = None
        n = 0
        for at in sorted(a for k, a in rows if k == key):
            if start is not None and (at - last > gap or at - start >= limit):
                out.append((key, "session", start, last, n))
                start, n = None, 0
            start, last, n = (at if start is None else start), at, n + 1
        out.append((key, "session", start, last, n))
    return sorted(out)


def test_sessions_in_any_order_late_rows_and_the_end(spark, tmp_path):
    """Three files whose rows overlap within the watermark; all sessions come out, the last of each key too, and no state stays."""
    rng = random.Random(2)
    source, rows = str(tmp_path / "in"), []
    for part in range(3):
        own = [(k, (part * 100 + rng.randrange(130)) * S) for k in range(4) for _ in range(25)]
        rows += own
        spark.createDataFrame(own, "key long, at long").coalesce(1).write.mode("append").parquet(source)
    late = spark.createDataFrame([(1, 5 * S), (9, 6 * S)], "key long, at long")
    events = lambda: spark.readStream.schema("key long, at long").option("maxFilesPerTrigger", 1).parquet(source)
    made = lambda df: stateful.limited_sessions(df, "key", 3 * S, 20 * S, "150 seconds")
    found = [tuple(r) for r in stateful.flushed(spark, events, "key", made, late).collect()]
    assert sorted(r for r in found if r[1] == "session") == plain(rows, 3 * S, 20 * S)
    assert sorted(r for r in found if r[1] == "late") == [(1, "late", 5 * S, 5 * S, 1), (9, "late", 6 * S, 6 * S, 1)]


def test_state_of_finished_keys_is_gone(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, "key long, at long").coalesce(1).write.mode("append").parquet(source)
        made = stateful.limited_sessions(spark.readStream.schema("key long, at long").parquet(source), "key", 5 * S, 60 * S, "10 seconds")
        made.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}-p").trigger(availableNow=True).start(out).awaitTermination()

    def held(name):
        return spark.read.format("statestore").option("path", f"{out}-p").option("stateVarName", name).load().count()

    run([(k, (100 + k) * S) for k in range(5)])
    assert held("waiting") == 5 and held("open") == 0
    run([(7, 500 * S)])
    assert held("waiting") == 1 and held("open") == 0
    assert spark.read.parquet(out).count() == 5
