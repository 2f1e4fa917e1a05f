"""Streams and audited sources. Streams run over all that is there (availableNow) and give their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.instants import micros
from ..sources import files
from ..streaming import stateful, streams
from . import Register, read

register = Register()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_ROWS = "r AS (SELECT epoch_us(ts) AS a, event_id AS p, user_id AS u FROM events WHERE ts IS NOT NULL)"


def _stream(spark, sf_dir, table):
    schema = read(spark, sf_dir, table).schema
    return streams.source(spark, f"{sf_dir}/{table}.parque[t]", schema)


def _name():
    return f"flow_{uuid.uuid4().hex}"


@register("SX-1 SX-3", f"WITH {_ROWS}, g AS (SELECT *, a - lag(a) OVER (ORDER BY a, p) AS gap FROM r), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 600000000 THEN 1 ELSE 0 END) OVER (ORDER BY a, p ROWS UNBOUNDED PRECEDING) AS session FROM g), o AS (SELECT count(*) AS n, min(a) AS start_us, max(a) AS end_us FROM s GROUP BY session) SELECT * FROM o WHERE end_us + 600000000 <= (SELECT max(a) FROM r) // 1000 * 1000 - 60000000")
def stream_gap_sessions(spark, sf_dir):
    """Sessions of the event stream that the watermark has passed; the same as in batch."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    made = streams.finished(streams.gap_sessions(events, "600 seconds", "60 seconds"), _name())
    return made.select("n", micros(F.col("start_at")).alias("start_us"), micros(F.col("end_at")).alias("end_us"))


@register("SX-4", "SELECT count(DISTINCT user_id) AS ids, count(DISTINCT user_id) AS n FROM events")
def stream_distinct_users(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts")
    made = streams.finished(streams.distinct_ids(events, "user_id", "60 days"), _name())
    return made.agg(F.countDistinct("user_id").alias("ids"), F.count(F.lit(1)).alias("n"))


@register("SX-2 SX-3", f"""WITH RECURSIVE {_ROWS}, g AS (SELECT *, a - lag(a) OVER (PARTITION BY u ORDER BY a, p) AS gap FROM r), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY a, p ROWS UNBOUNDED PRECEDING) AS session FROM g),
f AS (SELECT u, session, min(a) AS start_at FROM s GROUP BY ALL UNION ALL SELECT u, session, (SELECT min(a) FROM s WHERE s.u = f.u AND s.session = f.session AND s.a >= f.start_at + 432000000000) FROM f WHERE EXISTS (SELECT 1 FROM s WHERE s.u = f.u AND s.session = f.session AND s.a >= f.start_at + 432000000000)),
w AS (SELECT u, start_at, lead(start_at) OVER (PARTITION BY u ORDER BY start_at) AS next_at FROM f), o AS (SELECT w.u AS user_id, 'session' AS kind, w.start_at, max(r.a) AS end_at, count(*) AS n FROM w JOIN r ON r.u = w.u AND r.a >= w.start_at AND (r.a < w.next_at OR w.next_at IS NULL) GROUP BY ALL)
SELECT * FROM o UNION ALL SELECT u, 'late', a, a, 1 FROM r WHERE p % 100 = 7 AND a < (SELECT max(a) FROM r) - 7200000000""")
def stream_limited_sessions(spark, sf_dir):
    """All sessions by user, of two days' gap and five days at most, the last ones too as the stream is ended; every hundredth row comes once more, more than two hours late, and is told apart."""
    rows = lambda df: df.where("ts is not null and user_id is not null").select("user_id", micros(F.col("ts")).alias("at"), "event_id")
    table = rows(read(spark, sf_dir, "events"))
    end = table.agg(F.max("at").alias("end")).first()["end"]
    again = table.where((F.col("event_id") % 100 == 7) & (F.col("at") < F.lit(end) - 7_200_000_000))
    made = lambda df: stateful.limited_sessions(df, "user_id", 172_800_000_000, 432_000_000_000, "1 hour")
    return stateful.flushed(spark, lambda: rows(_stream(spark, sf_dir, "events")), "user_id", made, again)


@register("SX-5 LC-1", "WITH n AS (SELECT conv_id, turn, role, min(turn) OVER (PARTITION BY conv_id) AS base FROM conversations), e AS (SELECT conv_id, turn AS sequence, CASE WHEN turn = base THEN 'received' WHEN role = 'user' THEN 'processing' WHEN role = 'assistant' THEN 'pending_approval' ELSE 'failed' END AS t FROM n), l AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY sequence) AS s FROM e) SELECT conv_id, sequence, s AS source_status, t AS target_status FROM l WHERE s IS NOT NULL AND (s, t) NOT IN (('received', 'processing'), ('processing', 'pending_approval'), ('processing', 'failed'), ('failed', 'processing'))")
def stream_lifecycle_problems(spark, sf_dir):
    """Illegal steps of a state machine over arriving turns; roles stand for states."""
    turns = _stream(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("sequence"), "role")
    first = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("base"))
    status = F.when(F.col("sequence") == F.col("base"), "received").when(F.col("role") == "user", "processing").when(F.col("role") == "assistant", "pending_approval").otherwise("failed")
    events = turns.join(first, "conv_id").select("conv_id", "sequence", status.alias("target_status"))
    return streams.finished(streams.lifecycle_problems(events, "conv_id"), _name())


@register("SRC-3")
def source_fingerprints(spark, sf_dir):
    """Length and digest of the files of all tables, hashed where they are read."""
    made = None
    for table in TABLES:
        own = files.fingerprints(spark, f"{sf_dir}/{table}.parquet").select(F.lit(table).alias("table_name"), "length", "sha256")
        made = own if made is None else made.unionAll(own)
    return made


@register("SRC-9", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'duplicate_key' WHEN 2 THEN 'not_finite' WHEN 3 THEN 'root' WHEN 4 THEN 'syntax' ELSE CASE WHEN props IS NULL THEN 'missing' END END AS problem FROM events")
def strict_json_events(spark, sf_dir):
    """Repeated keys, non-finite numbers, other roots, broken and missing texts are problems; five texts of six are given one."""
    kind = F.col("event_id") % 6
    props = F.when(kind == 1, '{"a": 1, "a": 2}').when(kind == 2, '{"a": NaN}').when(kind == 3, "[1]").when(kind == 4, '{"a": ').when(kind == 5, F.col("props"))
    return read(spark, sf_dir, "events").withColumn("props", props).select("event_id", files.json_problem("props").alias("problem"))


@register("PRJ-5 SRC-5", "SELECT 'p_name' AS column_name, count(*) AS nulls FROM part WHERE p_partkey % 10 = 3")
def required_columns_part(spark, sf_dir):
    """Columns with nulls where none may be; every tenth name is taken out."""
    part = read(spark, sf_dir, "part").withColumn("p_name", F.when(F.col("p_partkey") % 10 != 3, F.col("p_name")))
    return files.null_violations(part, ["p_name", "p_size"])


@register("SNK-9", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0)")
def insert_ignoring_conflicts(spark, sf_dir):
    """Rows that an insert with ON CONFLICT DO NOTHING would add."""
    stored = read(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return files.append_new(stored, read(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])
