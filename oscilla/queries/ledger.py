"""Contract and quality ledger over derived readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import instants
from ..operators import contract, quality
from ..sources.readings import CONTRACT, DUCK_READINGS, FEATURES, derived
from . import Register, read

register = Register()

@register("PRJ-1 PRJ-2 FN-28", f"WITH {DUCK_READINGS} SELECT id, list_reduce([{', '.join(FEATURES)}], lambda a, b: a + b) AS total, 18 AS dimension FROM readings")
def feature_projection_readings(spark, sf_dir):
    """The 18 features of the 26 columns, as a vector (here its sum and length)."""
    v = F.array(*FEATURES)
    return derived(spark, sf_dir).select("id", F.aggregate(v, F.lit(0.0), lambda a, b: a + b).alias("total"), F.size(v).alias("dimension"))


@register(
    "PRJ-3 PRJ-4 PRJ-5 PRJ-6 PRJ-7 PRJ-8 PRJ-9 SO-1",
    f"WITH {DUCK_READINGS} SELECT 'domain' AS stage, 'label_not_allowed' AS code, 'fault' AS column_name, count(*)::BIGINT AS affected FROM readings WHERE fault NOT IN ('click', 'view') HAVING count(*) > 0",
)
def contract_report_readings(spark, sf_dir):
    """Structure, types, missing and infinite values are in order, so the domain stage speaks."""
    return contract.report(derived(spark, sf_dir).drop("ts"), allowed=["click", "view"])


@register(
    "PRJ-5 PRJ-8",
    f"""WITH {DUCK_READINGS}, b AS (SELECT CASE WHEN id % 40 = 0 THEN NULL ELSE rpm END AS rpm, CASE WHEN id % 60 = 0 THEN 'NaN'::DOUBLE ELSE z_kurtosis END AS z FROM readings)
    SELECT 'missing' AS stage, 'null' AS code, 'rpm' AS column_name, count(*)::BIGINT AS affected FROM b WHERE rpm IS NULL UNION ALL SELECT 'missing', 'nan', 'z_kurtosis', count(*) FROM b WHERE isnan(z)""",
)
def contract_missing_readings(spark, sf_dir):
    """With holes made: null and NaN are told apart, and later stages wait."""
    df = derived(spark, sf_dir).drop("ts")
    df = df.withColumn("rpm", F.when(F.col("id") % 40 != 0, F.col("rpm"))).withColumn("z_kurtosis", F.when(F.col("id") % 60 == 0, F.lit(float("nan"))).otherwise(F.col("z_kurtosis")))
    return contract.report(df.select(*(c.name for c in CONTRACT)))


_LEDGER = f"""WITH {DUCK_READINGS}, k AS (SELECT id, count(*) AS copies, count(DISTINCT rpm) AS kinds FROM readings GROUP BY id),
l AS (SELECT r.id, r.rpm, copies > 1 AND kinds > 1 AS conflict, copies > 1 AND kinds = 1 AS same,
  abs(temperature_f - (temperature_c * 1.8 + 32.0)) > greatest(1e-6, 1e-6 * greatest(abs(temperature_f), abs(temperature_c * 1.8 + 32.0))) OR abs(z_rms_velocity_in_s - z_rms_velocity_mm_s * (1 / 25.4)) > greatest(1e-6, 1e-6 * greatest(abs(z_rms_velocity_in_s), abs(z_rms_velocity_mm_s / 25.4))) AS unit
  FROM readings r JOIN k USING (id)),
d AS (SELECT *, CASE WHEN conflict THEN 'rejected' WHEN unit THEN 'corrected' WHEN same THEN 'mapped' ELSE 'kept' END AS disposition FROM l)"""


@register(
    "PL-3 PL-6 FN-25 FN-26 JN-4 JN-5 PRJ-10 SO-6 ST-6",
    _LEDGER + """ SELECT id, rpm, disposition, concat_ws(',', CASE WHEN conflict THEN 'conflicting_duplicate' END, CASE WHEN unit THEN 'inconsistent_redundant_unit' END, CASE WHEN same THEN 'identical_duplicate' END) AS reasons,
    concat_ws(',', CASE WHEN conflict THEN 'duplicate.conflicting.reject' END, CASE WHEN unit THEN 'unit.inconsistent.deterministic' END, CASE WHEN same THEN 'duplicate.identical.map_identity' END) AS rules FROM d""",
)
def quality_ledger_readings(spark, sf_dir):
    """Each record's disposition, reasons and rules."""
    made = quality.resolve(quality.matches(derived(spark, sf_dir)))
    return made.select("id", "rpm", "disposition", F.array_join("reason_codes", ",").alias("reasons"), F.array_join("rules", ",").alias("rules"))


@register("AG-21 FN-25", _LEDGER + " SELECT v.disposition, count(d.id) AS n FROM (SELECT unnest(['rejected', 'corrected', 'mapped', 'flagged', 'kept']) AS disposition) v LEFT JOIN d USING (disposition) GROUP BY 1")
def disposition_counts_readings(spark, sf_dir):
    """Complete over the closed set of dispositions."""
    made = quality.resolve(quality.matches(derived(spark, sf_dir)))
    return quality.complete_counts(made, "disposition", [d for _, d in quality.ACTIONS])


_FEN = ["temperature_c", "z_rms_velocity_mm_s", "rpm"]


@register(
    "AG-20 PL-4",
    f"WITH {DUCK_READINGS}, f AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS low{i}, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS high{i}" for i, c in enumerate(_FEN)) + " FROM readings WHERE id % 10 < 7) SELECT id, rpm FROM readings, f WHERE " + " OR ".join(f"{c} < low{i} OR {c} > high{i}" for i, c in enumerate(_FEN)),
)
def iqr_flags_train_fit(spark, sf_dir):
    """Fences fitted on one part of the readings, applied to all; strictly outside only."""
    df = derived(spark, sf_dir).withColumn("rules", F.array().cast("array<string>"))
    return quality.flag_outliers(df, quality.fences(df.where("id % 10 < 7"), _FEN), _FEN).where(F.array_contains("rules", "outlier.iqr.flag")).select("id", "rpm")


@register("WN-3", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1 AS duplicate_ordinal FROM lineitem")
def duplicate_ordinal_lineitem(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("position", F.struct("l_partkey", "l_suppkey", "l_extendedprice"))
    return quality.duplicate_ordinal(df, ["l_orderkey", "l_linenumber"], "position").select("l_orderkey", "l_linenumber", "l_partkey", F.col("duplicate_ordinal").cast("long").alias("duplicate_ordinal"))


@register("FN-1 FN-2 FN-3", f"WITH {DUCK_READINGS} SELECT id, rpm, epoch_us(ts) // 1000000 AS sec, epoch_us(ts) % 1000000 AS micros, created_at AS text FROM readings")
def instants_readings(spark, sf_dir):
    """Text with a zone to exact instants and back to canonical text."""
    at = instants.parse(F.col("created_at"))
    return derived(spark, sf_dir).select("id", "rpm", at["sec"].alias("sec"), (at["frac"] * 1000000).cast("long").alias("micros"), instants.canonical(at).alias("text"))


@register("FN-8", f"WITH {DUCK_READINGS} SELECT id, rpm, sha256(concat_ws(':', id::VARCHAR, created_at, fault)) AS record_id FROM readings")
def record_identity_readings(spark, sf_dir):
    return derived(spark, sf_dir).select("id", "rpm", F.sha2(F.concat_ws(":", F.col("id").cast("string"), "created_at", "fault"), 256).alias("record_id"))
