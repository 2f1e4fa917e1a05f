"""Profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.instants import micros
from ..functions.numbers import percentage
from ..operators import profile, quantiles, selection
from . import Register, read

register = Register()
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENT_TYPES = ["click", "view", "purchase", "refund"]


def _rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


@register("AG-1 PL-7", "SELECT count(*)::BIGINT AS row_count, 11 AS column_count FROM lineitem")
def volume_profile_lineitem(spark, sf_dir):
    return profile.volume(read(spark, sf_dir, "lineitem"))


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, round(min({c}), 6) AS minimum, round(max({c}), 6) AS maximum, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS deviation, "
    f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75 FROM lineitem"
    for c in NUMERIC
)
_OUTSIDE = " ".join(f"WHEN '{c}' THEN (SELECT count(*) FROM lineitem WHERE {c} < s.q25 - 1.5 * (s.q75 - s.q25) OR {c} > s.q75 + 1.5 * (s.q75 - s.q25))" for c in NUMERIC)


@register(
    "SRC-5 AG-3 AG-4 PL-7",
    f"WITH s AS ({_STATS}) SELECT column_name, n, minimum, maximum, mean, deviation, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, round(q75 - q25, 6) AS iqr, "
    f"round(q25 - 1.5 * (q75 - q25), 6) AS lower_fence, round(q75 + 1.5 * (q75 - q25), 6) AS upper_fence, CASE column_name {_OUTSIDE} END AS outliers FROM s",
)
def numeric_profile_lineitem(spark, sf_dir):
    """The flagship: a numeric profile with fences and outliers."""
    made = profile.numeric(read(spark, sf_dir, "lineitem"), NUMERIC)
    return _rounded(made, "minimum", "maximum", "mean", "deviation", "q25", "median", "q75", "iqr", "lower_fence", "upper_fence")


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@register(
    "AG-2 AG-15 PRJ-5 PRJ-6 PRJ-7 FN-24",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS observed, count(*) - count({c}) AS nulls, 0::BIGINT AS nans, 0::BIGINT AS infinities, "
        + ("count(*) FILTER (o_totalprice < 1000)" if c == "o_totalprice" else "count(*) FILTER (o_orderstatus NOT IN ('O', 'F'))" if c == "o_orderstatus" else "0::BIGINT")
        + f" AS outside_domain, round_even(100.0 * count({c}) / count(*), 6)::DOUBLE AS observed_percent FROM orders"
        for c in _ORDERS
    ),
)
def column_completeness_orders(spark, sf_dir):
    domains = {"o_totalprice": F.col("o_totalprice") >= 1000, "o_orderstatus": F.col("o_orderstatus").isin("O", "F")}
    return profile.completeness(read(spark, sf_dir, "orders").select(*_ORDERS), domains)


@register("AG-8", "WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag) SELECT count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS excess_rows FROM g")
def row_duplicates_lineitem(spark, sf_dir):
    return profile.row_duplicates(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@register(
    "AG-9",
    """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT lineitem) AS d FROM lineitem GROUP BY ALL)
    SELECT 0::BIGINT AS incomplete_keys, count(*) FILTER (n > 1) AS duplicate_keys, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS excess_rows, count(*) FILTER (n > 1 AND d > 1) AS conflicting_keys FROM g""",
)
def dup_key_profile_lineitem(spark, sf_dir):
    return profile.key_duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "AG-9 (build variant, label ignored)",
    """WITH r AS (SELECT event_id % 500 AS k, event_type, count(*) AS same FROM events GROUP BY ALL), g AS (SELECT k, sum(same) AS n, 1 AS d FROM r GROUP BY k)
    SELECT 0::BIGINT AS incomplete_keys, count(*) FILTER (n > 1) AS duplicate_keys, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS excess_rows, 0::BIGINT AS conflicting_keys FROM g""",
)
def dup_key_ignoring_label_events(spark, sf_dir):
    return profile.key_duplicates(read(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("k"), "event_type"), ["k"], ignore=("event_type",))


@register(
    "AG-10 PRJ-9 SO-3",
    f"""WITH c AS (SELECT event_type AS label, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1), a AS (SELECT unnest({EVENT_TYPES!r}) AS label), t AS (SELECT count(event_type) AS total FROM events),
    u AS (SELECT a.label, true AS approved, coalesce(c.n, 0) AS n FROM a LEFT JOIN c USING (label) UNION ALL SELECT 'unapproved_' || row_number() OVER (ORDER BY n DESC, label), false, n FROM c WHERE label NOT IN (SELECT label FROM a))
    SELECT label, approved, n, CASE WHEN n <> 0 AND round_even(100.0 * n / total, 6) = 0 THEN NULL ELSE round_even(100.0 * n / total, 6)::DOUBLE END AS percent FROM u, t""",
)
def label_distribution_events(spark, sf_dir):
    return profile.label_distribution(read(spark, sf_dir, "events"), "event_type", EVENT_TYPES)


@register(
    "AG-11",
    "WITH c AS (SELECT count(*) AS n FROM events GROUP BY event_type), t AS (SELECT sum(n) AS s, count(*) AS k FROM c) SELECT max(k)::BIGINT AS categories, max(s)::BIGINT AS total, round(-sum((n / s) * ln(n / s)) / ln(max(k)), 6) AS entropy FROM c, t",
)
def label_entropy_events(spark, sf_dir):
    return profile.normalized_entropy(read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))


@register(
    "AG-12 PRJ-10 JN-5",
    """WITH j AS (SELECT l_extendedprice AS o, l_quantity * p_retailprice AS e FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT count(*) AS comparable, count(*) FILTER (abs(o - e) <= greatest(1e-6, 0.5 * greatest(abs(o), abs(e)))) AS consistent, round(max(abs(o - e)), 6) AS largest_error FROM j""",
)
def unit_pair_profile(spark, sf_dir):
    """A derived pair: the price of a line against quantity times the part's price, at a wide tolerance."""
    both = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_extendedprice").alias("o"), (F.col("l_quantity") * F.col("p_retailprice")).alias("e"))
    from ..functions.numbers import within_tolerance

    return both.agg(F.count(F.lit(1)).alias("comparable"), F.count_if(within_tolerance(F.col("o"), F.col("e"), relative=0.5)).alias("consistent"), F.round(F.max(F.abs(F.col("o") - F.col("e"))), 6).alias("largest_error"))


_STEPS = "WITH d AS (SELECT DISTINCT epoch_us(ts) AS moment FROM events WHERE ts IS NOT NULL), s AS (SELECT moment, moment - lag(moment) OVER (ORDER BY moment) AS gap FROM d), c AS (SELECT gap, count(*) AS n FROM s WHERE gap IS NOT NULL GROUP BY gap), m AS (SELECT gap AS cadence, n AS intervals FROM c ORDER BY n DESC, gap LIMIT 1)"


@register("AG-14 WN-1", _STEPS + " SELECT cadence, intervals FROM m")
def nominal_cadence_events(spark, sf_dir):
    return profile.nominal_cadence(read(spark, sf_dir, "events"), micros(F.col("ts")))


@register(
    "AG-13 WN-1 AG-36",
    _STEPS + """ SELECT (SELECT count(ts) FROM events) AS valid, (SELECT count(*) - count(ts) FROM events) AS invalid, count(*) AS distinct_instants, min(moment) AS first_at, max(moment) AS last_at, max(cadence) AS cadence,
    count(*) FILTER (gap <> cadence) AS irregular, count(*) FILTER (gap > 2 * cadence) AS gaps, coalesce(sum(gap) FILTER (gap > 2 * cadence), 0)::BIGINT AS gap_total, max(gap) AS largest_gap FROM s, m""",
)
def temporal_profile_events(spark, sf_dir):
    return profile.temporal(read(spark, sf_dir, "events"), micros(F.col("ts")))


@register(
    "WN-2",
    """WITH s AS (SELECT sign(epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY event_id)) AS step FROM events)
    SELECT CASE WHEN bool_and(step >= 0) AND bool_and(step <= 0) THEN 'constant' WHEN bool_and(step >= 0) THEN 'nondecreasing' WHEN bool_and(step <= 0) THEN 'nonincreasing' ELSE 'unordered' END AS input_order FROM s""",
)
def input_order_events(spark, sf_dir):
    return profile.input_order(read(spark, sf_dir, "events"), micros(F.col("ts")), F.col("event_id"))


@register(
    "AG-16 SO-1",
    """SELECT 'rows.observed' AS code, count(*)::BIGINT AS expected, count(l_orderkey)::BIGINT AS actual, count(*) = count(l_orderkey) AS passed FROM lineitem UNION ALL
    SELECT 'flags.sum', count(*), count(*) FILTER (l_returnflag IN ('A', 'N', 'R')), count(*) = count(*) FILTER (l_returnflag IN ('A', 'N', 'R')) FROM lineitem UNION ALL
    SELECT 'keys.distinct', count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""",
)
def reconciliation_checks_lineitem(spark, sf_dir):
    n = F.count(F.lit(1))
    return profile.reconciled(read(spark, sf_dir, "lineitem"), {"rows.observed": (n, F.count("l_orderkey")), "flags.sum": (n, F.count_if(F.col("l_returnflag").isin("A", "N", "R"))), "keys.distinct": (n, F.countDistinct(F.struct("l_orderkey", "l_linenumber")))})


@register(
    "AG-17",
    """WITH s AS (SELECT count(*) AS n, count(*) FILTER (l_quantity < 0) AS negative, count(*) FILTER (l_discount > 0.09) AS high, count(DISTINCT l_returnflag) AS flags FROM lineitem),
    g AS (SELECT 'volume.nonempty' AS gate, 'blocking' AS kind, n AS observed, n > 0 AS passed FROM s UNION ALL SELECT 'domain.nonnegative', 'blocking', negative, negative = 0 FROM s UNION ALL SELECT 'discount.high', 'alert', high, high = 0 FROM s UNION ALL SELECT 'labels.observed', 'observation', flags, NULL FROM s)
    SELECT gate, kind, observed, passed, (SELECT bool_and(passed) FROM g WHERE kind = 'blocking') AS accepted FROM g""",
)
def baseline_gates_lineitem(spark, sf_dir):
    """Blocking, alert and observation gates; accepted if every blocking one passed."""
    s = read(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") < 0).alias("negative"), F.count_if(F.col("l_discount") > 0.09).alias("high"), F.countDistinct("l_returnflag").alias("flags"))
    none = F.lit(None).cast("boolean")
    rows = [("volume.nonempty", "blocking", F.col("n"), F.col("n") > 0), ("domain.nonnegative", "blocking", F.col("negative"), F.col("negative") == 0), ("discount.high", "alert", F.col("high"), F.col("high") == 0), ("labels.observed", "observation", F.col("flags"), none)]
    gates = F.array(*(F.struct(F.lit(a).alias("gate"), F.lit(k).alias("kind"), o.alias("observed"), p.alias("passed")) for a, k, o, p in rows))
    accepted = F.forall(F.filter(gates, lambda g: g["kind"] == "blocking"), lambda g: g["passed"])
    return s.select(F.explode(gates).alias("g"), accepted.alias("accepted")).select("g.*", "accepted")


_PLANTED = """p AS (SELECT event_id, ts, event_type, value, value * 1.8 + 32 + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS fahrenheit FROM events UNION ALL SELECT event_id, ts, event_type, value, value * 1.8 + 32 + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END FROM events WHERE event_id % 50 = 0 UNION ALL SELECT event_id, ts, event_type, value + 1, (value + 1) * 1.8 + 32 FROM events WHERE event_id % 70 = 0)"""
_FINDINGS = f"""WITH {_PLANTED}, k AS (SELECT event_type, count(*) AS n FROM p WHERE event_type IS NOT NULL GROUP BY 1), w AS (SELECT count(*) AS n FROM p), g AS (SELECT event_id, count(*) AS n, count(DISTINCT (ts, event_type, value, fahrenheit)) AS kinds FROM p GROUP BY 1), dd AS (SELECT event_id, ts, event_type, value, fahrenheit, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT DISTINCT epoch_us(ts) AS a FROM p WHERE ts IS NOT NULL), s AS (SELECT a - lag(a) OVER (ORDER BY a) AS gap FROM t), cd AS (SELECT gap AS cadence FROM s WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1), u AS (SELECT abs(fahrenheit - (value * 1.8 + 32)) <= greatest(1e-6, 1e-6 * greatest(abs(fahrenheit), abs(value * 1.8 + 32))) AS ok FROM p WHERE value IS NOT NULL),
q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM p), f(code, n) AS (VALUES ('contract.banner', (SELECT count(*) FILTER (ts IS NULL) + count(*) FILTER (event_type IS NULL) FROM p)), ('expectation.fault_cardinality', (SELECT CASE WHEN count(*) = 4 THEN 0 ELSE 1 END FROM k)),
('reconciliation.aggregate_counts', (SELECT CASE WHEN count(event_type) = count(*) THEN 0 ELSE 1 END FROM p)), ('expectation.dimensions', 1), ('quality.complete_duplicates', (SELECT sum(n - 1) FROM dd)), ('quality.repeated_ids', (SELECT count(*) FROM g WHERE n > 1)), ('quality.conflicting_ids', (SELECT count(*) FROM g WHERE kinds > 1)),
('quality.irregular_cadence', (SELECT count(*) FROM s, cd WHERE gap <> cadence)), ('quality.temporal_gaps', (SELECT count(*) FROM s, cd WHERE gap > 2 * cadence)), ('quality.redundant_pairs', (SELECT count(*) FILTER (NOT ok) FROM u)), ('observation.temporal_period', 1), ('observation.column_statistics', 1),
('observation.iqr_outliers', (SELECT count(*) FROM p, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))), ('observation.anonymous_fault_distribution', (SELECT count(*) FROM k)), ('observation.fault_imbalance', (SELECT max(n) - min(n) FROM k)), ('observation.redundant_pair_consistency', (SELECT count(*) FILTER (ok) FROM u))),
i(code, classification) AS (VALUES {", ".join(str(x) for x in profile.INDICATORS)}), r AS (SELECT code, classification, coalesce(n, 0)::BIGINT AS finding_count, classification = 'observation' OR coalesce(n, 0) = 0 AS passed FROM i LEFT JOIN f USING (code))"""


@register("AG-17", _FINDINGS + " SELECT code, classification, passed, finding_count, (SELECT bool_and(passed) FROM r WHERE classification = 'blocking') AS accepted FROM r")
def baseline_indicators_events(spark, sf_dir):
    """All indicators of a baseline over events with planted repeats, conflicts, wrong pairs, and another size than expected."""
    e, n = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value"), F.col("event_id")
    f = F.col("value") * 1.8 + 32
    own = e.withColumn("fahrenheit", f + F.when(n % 97 == 0, 1).otherwise(0))
    planted = own.unionByName(own.where(n % 50 == 0)).unionByName(e.where(n % 70 == 0).withColumn("value", F.col("value") + 1).withColumn("fahrenheit", f))
    made = profile.findings(planted, "event_id", micros(F.col("ts")), "event_type", ["ts", "event_type"], ["value"], (F.col("fahrenheit"), f), 0, 5, 4)
    return profile.indicators(made)


@register(
    "AG-4 AG-5 AG-6 AG-7",
    """WITH v AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
    SELECT round((SELECT quantile_cont(l_extendedprice, 0.95) FROM lineitem), 6) AS interpolated, max(x) FILTER (i = floor((n - 1) * 0.95)) AS lower_element, max(x) FILTER (i = ceil((n - 1) * 0.95)) AS higher_element, (SELECT quantile_disc(l_extendedprice, 0.95) FROM lineitem) AS nearest_rank FROM v""",
)
def quantile_definitions_lineitem(spark, sf_dir):
    """The four definitions side by side; they are never exchanged for each other."""
    df = read(spark, sf_dir, "lineitem").select("l_extendedprice")
    price = {"l_extendedprice": F.col("l_extendedprice")}
    found = quantiles.elements(df, price, (0.95,)).select("column_name", F.col("low").alias("lower_element"), F.col("high").alias("higher_element"), F.col("nearest").alias("nearest_rank"))
    plain = quantiles.interpolated(df, price, (0.95,)).select("column_name", F.round(F.get("values", F.lit(0)), 6).alias("interpolated"))
    return found.join(F.broadcast(plain), "column_name").select("interpolated", "lower_element", "higher_element", "nearest_rank")


_ROW_HASH = "sha256(concat_ws('|', coalesce(o_orderkey::VARCHAR, '\\N'), coalesce(o_custkey::VARCHAR, '\\N'), coalesce(o_orderstatus, '\\N'), coalesce((round(o_totalprice * 100))::BIGINT::VARCHAR, '\\N')))"
_WORDS = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8))


@register("AG-34 FN-8", f"WITH r AS (SELECT {_ROW_HASH} AS h FROM orders) SELECT count(*) AS row_count, sha256(concat_ws(':', count(*)::VARCHAR, {_WORDS})) AS digest FROM r")
def table_hash_orders(spark, sf_dir):
    """Floats enter as whole cents, never as text."""
    return profile.table_hash(read(spark, sf_dir, "orders"), [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.round(F.col("o_totalprice") * 100).cast("long")])


@register("AG-36 AG-35", "SELECT count(*) AS row_count, count(DISTINCT ts) AS instants, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events")
def distinct_counts_events(spark, sf_dir):
    return read(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("ts").alias("instants"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"))


@register("AG-31 AG-6 AG-7", "SELECT event_type AS layer, count(*) AS attempts, count(*) FILTER (value >= 20) AS valid, count(*) FILTER (value < 20 OR value IS NULL) AS errors, quantile_disc(value, 0.5) FILTER (value >= 20) AS p50, quantile_disc(value, 0.95) FILTER (value >= 20) AS p95, round(quantile_cont(value, 0.95) FILTER (value >= 20), 6) AS p95_interpolated FROM events GROUP BY event_type")
def latency_summary_events(spark, sf_dir):
    """Attempts and errors by layer; percentiles over successes alone, by nearest rank and interpolated."""
    ok = F.when(F.col("value") >= 20, F.col("value"))
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), ok.alias("ok"))
    counts = rows.groupBy("layer").agg(F.count(F.lit(1)).alias("attempts"), F.count("ok").alias("valid"), F.count_if(F.col("ok").isNull()).alias("errors"))
    found = selection.quantiles(rows, ["layer"], F.col("ok"), (0.5, 0.95))
    at = lambda q, c: F.max(F.when(F.col("q") == q, c))
    plain = selection.between(F.col("low"), F.col("high"), F.col("n"), F.col("q"))
    made = found.groupBy("layer").agg(at(0.5, F.col("nearest")).alias("p50"), at(0.95, F.col("nearest")).alias("p95"), F.round(at(0.95, plain), 6).alias("p95_interpolated"))
    return counts.join(made, counts["layer"].eqNullSafe(made["layer"])).drop(made["layer"])


_GROUPED = "WITH v AS (SELECT {by}, l_extendedprice AS x, row_number() OVER (PARTITION BY {by} ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM lineitem), q AS (SELECT unnest([0.25, 0.5, 0.99]) AS q) SELECT {by}, q::DOUBLE AS q, n, max(x) FILTER (i = floor((n - 1) * q)) AS low, max(x) FILTER (i = ceil((n - 1) * q)) AS high, max(x) FILTER (i = greatest(ceil(n * q) - 1, 0)) AS nearest FROM v, q GROUP BY {by}, q, n"


@register("AG-4 AG-5 AG-6", _GROUPED.format(by="l_returnflag, l_linestatus"))
def grouped_quantiles_lineitem(spark, sf_dir):
    """Quartile, median and 0.99 of prices of every flag and status: large groups, narrowed by bins."""
    return selection.quantiles(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), (0.25, 0.5, 0.99))


@register("AG-4 AG-5 AG-6", _GROUPED.format(by="l_suppkey"))
def supplier_quantiles_lineitem(spark, sf_dir):
    """The same for every supplier: many small groups."""
    return selection.quantiles(read(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"), (0.25, 0.5, 0.99))


@register("AG-15 AG-28", "SELECT l_returnflag, count(*) AS n, CASE WHEN count(*) FILTER (l_linestatus = 'X') = 0 THEN NULL END::DOUBLE AS share_of_none, round_even(100.0 * count(*) FILTER (l_linestatus = 'O') / count(*), 6)::DOUBLE AS open_percent FROM lineitem GROUP BY 1")
def percentages_lineitem(spark, sf_dir):
    """Null on a zero denominator."""
    n, x = F.count(F.lit(1)), F.count_if(F.col("l_linestatus") == "X")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(n.alias("n"), percentage(n, x).alias("share_of_none"), percentage(F.count_if(F.col("l_linestatus") == "O"), n).alias("open_percent"))
