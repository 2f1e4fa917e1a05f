"""Sessions and temporal splits over the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.instants import micros
from ..operators import ordering, sessions, split
from . import Register, read

register = Register()
GAP = 600_000_000
SHORT_GAP = 300_000_000
HOUR = 3_600_000_000


def rows(spark, sf_dir):
    return read(spark, sf_dir, "events").where("ts is not null").select(micros(F.col("ts")).alias("at"), F.col("event_id").alias("position"))


_ROWS = "r AS (SELECT epoch_us(ts) AS a, event_id AS p, user_id AS u FROM events WHERE ts IS NOT NULL)"
_GAPS = f"WITH {_ROWS}, g AS (SELECT *, a - lag(a) OVER (ORDER BY a, p) AS gap FROM r), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {GAP} THEN 1 ELSE 0 END) OVER (ORDER BY a, p ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)"


@register("WN-4 WN-1 ST-1", _GAPS + " SELECT p AS position, gap, session FROM s")
def gap_sessions_events(spark, sf_dir):
    """One global stream; a gap equal to the threshold does not break."""
    return sessions.gap_sessions(rows(spark, sf_dir), GAP).select("position", "gap", "session")


@register("WN-4 AG-36", f"WITH {_ROWS}, g AS (SELECT *, a - lag(a) OVER (PARTITION BY u ORDER BY a, p) AS gap FROM r), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {24 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY a, p ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) SELECT u AS user_id, session, count(*) AS n, min(a) AS start_at, max(a) AS end_at FROM s GROUP BY ALL")
def user_sessions_events(spark, sf_dir):
    df = read(spark, sf_dir, "events").where("ts is not null").select("user_id", micros(F.col("ts")).alias("at"), F.col("event_id").alias("position"))
    return sessions.summary(sessions.keyed_gap_sessions(df, ["user_id"], 24 * HOUR), ["user_id", "session"])


@register("WN-4 WN-6", _GAPS + " SELECT session, count(*) AS n, min(a) AS start_at, max(a) AS end_at, sum(count(*)) OVER (ORDER BY session)::BIGINT AS cumulative FROM s GROUP BY session")
def session_summary_events(spark, sf_dir):
    """Sessions with their running size."""
    return split.occurrences(sessions.gap_sessions(rows(spark, sf_dir), GAP)).select("session", "n", "start_at", "end_at", "cumulative")


@register(
    "WN-5",
    f"""WITH RECURSIVE {_ROWS}, g AS (SELECT *, a - lag(a) OVER (ORDER BY a, p) AS gap FROM r), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {GAP} THEN 1 ELSE 0 END) OVER (ORDER BY a, p ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g),
    f AS (SELECT session, min(a) AS start_at, 1::BIGINT AS part FROM s GROUP BY session UNION ALL SELECT f.session, (SELECT min(a) FROM s WHERE s.session = f.session AND s.a >= f.start_at + {HOUR}), f.part + 1 FROM f WHERE EXISTS (SELECT 1 FROM s WHERE s.session = f.session AND s.a >= f.start_at + {HOUR}))
    SELECT f.session, f.part, count(*) AS n, min(s.a) AS start_at, max(s.a) AS end_at FROM f JOIN s ON s.session = f.session AND s.a >= f.start_at AND s.a < coalesce((SELECT min(start_at) FROM f f2 WHERE f2.session = f.session AND f2.part = f.part + 1), 9223372036854775807) GROUP BY f.session, f.part""",
)
def duration_sessions_events(spark, sf_dir):
    """Sessions of an hour at most: a break at start + limit, and a new count from there."""
    made = sessions.limit_duration(sessions.gap_sessions(rows(spark, sf_dir), GAP).select("at", "position", "session"), HOUR)
    return sessions.summary(made, ["session", "part"])


_SPLIT = f"""WITH {_ROWS}, g AS (SELECT *, a - lag(a) OVER (ORDER BY a, p) AS gap FROM r), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {SHORT_GAP} THEN 1 ELSE 0 END) OVER (ORDER BY a, p ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g),
o AS (SELECT session, count(*) AS n, min(a) AS start_at, max(a) AS end_at, sum(count(*)) OVER (ORDER BY session)::BIGINT AS cumulative FROM s GROUP BY session),
w AS (SELECT count(*) AS k, max(cumulative) AS total FROM o), b1 AS (SELECT session AS b FROM o, w WHERE session BETWEEN 1 AND k - 2 ORDER BY abs(cumulative - total * 0.7), session LIMIT 1),
b2 AS (SELECT session AS b FROM o, w WHERE session BETWEEN (SELECT b + 1 FROM b1) AND k - 1 ORDER BY abs(cumulative - total * (0.7 + 0.15)), session LIMIT 1),
p AS (SELECT *, CASE WHEN session <= (SELECT b FROM b1) THEN 'train' WHEN session <= (SELECT b FROM b2) THEN 'validation' ELSE 'test' END AS part, CASE WHEN session <= (SELECT b FROM b1) THEN (SELECT start_at FROM o WHERE session = (SELECT b + 1 FROM b1)) WHEN session <= (SELECT b FROM b2) THEN (SELECT start_at FROM o WHERE session = (SELECT b + 1 FROM b2)) END AS next_at FROM o),
q AS (SELECT *, coalesce(NOT (next_at - end_at > 0 AND next_at - end_at >= {{purge}}), false) AS purged FROM p)"""


@register("WN-6 WN-7 WN-8 SO-4", _SPLIT.format(purge=SHORT_GAP) + " SELECT session, n, cumulative, CASE WHEN NOT purged THEN part END AS partition, CASE WHEN purged THEN 'purge' END AS exclusion FROM q")
def temporal_split_events(spark, sf_dir):
    """The split at a fixed threshold."""
    found = split.occurrences(sessions.gap_sessions(rows(spark, sf_dir), SHORT_GAP))
    return split.assign(found, split.boundaries(found), SHORT_GAP).select("session", "n", "cumulative", "partition", "exclusion")


@register("WN-8", _SPLIT.format(purge=40 * HOUR) + " SELECT CASE WHEN NOT purged THEN part ELSE 'purge' END AS destination, count(*) AS sessions, sum(n)::BIGINT AS n FROM q GROUP BY 1")
def purge_tail_events(spark, sf_dir):
    """A purge distance of 40 hours, far beyond the gap, so that tails go."""
    found = split.occurrences(sessions.gap_sessions(rows(spark, sf_dir), SHORT_GAP))
    made = split.assign(found, split.boundaries(found), 40 * HOUR)
    return made.groupBy(F.coalesce("partition", "exclusion").alias("destination")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


@register("WN-9 PL-1")
def temporal_split_fixed_point(spark, sf_dir):
    """Threshold and split fitted to a fixed point with a 24 h limit; held against a plain Python version in the tests."""
    threshold, made = split.fixed_point(rows(spark, sf_dir))
    return made.groupBy(F.coalesce("partition", "exclusion").alias("destination")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n")).withColumn("threshold_us", F.lit(threshold))


@register(
    "AG-22 JN-9 JN-10 SO-2 AG-21",
    _SPLIT.format(purge=SHORT_GAP) + """, x AS (SELECT s.p, CASE WHEN NOT q.purged THEN q.part END AS partition, q.session, s.a FROM s JOIN q USING (session))
    SELECT (SELECT count(*) FROM x) = (SELECT count(*) FROM events) AS ledger_complete, (SELECT count(DISTINCT p) FROM x) = (SELECT count(*) FROM x) AS eligible_coverage, (SELECT count(*) FROM (SELECT session FROM x WHERE partition IS NOT NULL GROUP BY session HAVING count(DISTINCT partition) > 1)) = 0 AS occurrence_disjoint,
    (SELECT max(a) FROM x WHERE partition = 'train') < (SELECT min(a) FROM x WHERE partition = 'validation') AND (SELECT max(a) FROM x WHERE partition = 'validation') < (SELECT min(a) FROM x WHERE partition = 'test') AS temporal_order,
    (SELECT min(a) FROM x WHERE partition = 'validation') - (SELECT max(a) FROM x WHERE partition = 'train') >= {gap} AND (SELECT min(a) FROM x WHERE partition = 'test') - (SELECT max(a) FROM x WHERE partition = 'validation') >= {gap} AS purge_gap, (SELECT count(DISTINCT partition) FROM x) = 3 AS nonempty""".format(gap=SHORT_GAP),
)
def leakage_gates_events(spark, sf_dir):
    """Coverage, disjointness, order, purge gap and emptiness of a split, each one aggregate."""
    r = rows(spark, sf_dir)
    s = sessions.gap_sessions(r, SHORT_GAP)
    found = split.occurrences(s)
    x = s.join(split.assign(found, split.boundaries(found), SHORT_GAP).select("session", "partition"), "session")
    when = lambda p, f: f(F.when(F.col("partition") == p, F.col("at")))
    one = x.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("ids"), when("train", F.max).alias("t1"), when("validation", F.min).alias("v0"), when("validation", F.max).alias("v1"), when("test", F.min).alias("e0"), F.countDistinct("partition").alias("parts"))
    mixed = x.where("partition is not null").groupBy("session").agg(F.countDistinct("partition").alias("k")).agg(F.count_if(F.col("k") > 1).alias("mixed"))
    source = read(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("source"))
    return one.crossJoin(mixed).crossJoin(source).select((F.col("n") == F.col("source")).alias("ledger_complete"), (F.col("ids") == F.col("n")).alias("eligible_coverage"), (F.col("mixed") == 0).alias("occurrence_disjoint"), ((F.col("t1") < F.col("v0")) & (F.col("v1") < F.col("e0"))).alias("temporal_order"), ((F.col("v0") - F.col("t1") >= SHORT_GAP) & (F.col("e0") - F.col("v1") >= SHORT_GAP)).alias("purge_gap"), (F.col("parts") == 3).alias("nonempty"))


@register("WN-14 KN-3", f"WITH {_ROWS}, o AS (SELECT p, row_number() OVER (ORDER BY a, p) - 1 AS i, count(*) OVER () AS n FROM r), m AS (SELECT DISTINCT (k * (n - 1)) // 511 AS i FROM o, range(512) t(k)) SELECT p AS position FROM o JOIN m USING (i)")
def evenly_spaced_sample_events(spark, sf_dir):
    """512 rows, evenly spaced in the global order; the running number is a sum over stretches."""
    r = rows(spark, sf_dir)
    numbered = ordering.running_sum(ordering.stretched(r, "at", "position"), F.lit(1), "number", "at", "position")
    total = r.count()
    wanted = spark.createDataFrame([(i + 1,) for i in sorted(set(sessions.evenly_spaced(total, 512)))], "number long")
    return numbered.join(F.broadcast(wanted), "number").select("position")


@register("WN-16", "WITH v AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, min(turn) OVER (PARTITION BY conv_id) AS base FROM conversations) SELECT conv_id, bool_and(turn - base + 1 = i) AS contiguous, max(i)::BIGINT AS applied FROM v GROUP BY conv_id")
def contiguous_prefix_conversations(spark, sf_dir):
    """Whether the numbered steps of each stream are 1..n without a hole."""
    w = Window.partitionBy("conv_id")
    v = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).cast("long").alias("i"), F.min("turn").over(w).alias("base"))
    return v.groupBy("conv_id").agg(F.bool_and(F.col("turn") - F.col("base") + 1 == F.col("i")).alias("contiguous"), F.max("i").alias("applied"))


@register("BM-1", "SELECT item_id AS iteration, CASE WHEN ('0x' || substr(sha256('schedule.v1:65:' || item_id), 1, 2))::INT % 2 = 0 THEN 'documented,abstained' ELSE 'abstained,documented' END AS scenarios FROM benchmark")
def scenario_schedule(spark, sf_dir):
    """Order of a pair of scenarios for each item of the benchmark, from one byte of a digest."""
    byte = F.conv(F.substring(F.sha2(F.concat(F.lit("schedule.v1:65:"), F.col("item_id").cast("string")), 256), 1, 2), 16, 10).cast("int")
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("iteration"), F.when(byte % 2 == 0, "documented,abstained").otherwise("abstained,documented").alias("scenarios"))
