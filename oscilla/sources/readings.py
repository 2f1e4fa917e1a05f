"""The sensor table: its contract, its readers, and readings derived from the event stream for tables without sensors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """A contract column: its kind (long, double, instant, text), inclusive minimum, and whether it is a model feature."""

    name: str
    kind: str
    minimum: float | None = None
    feature: bool = False


#: The 26 columns in their order.
CONTRACT = (
    Rule("id", "long"), Rule("created_at", "instant"),
    Rule("z_rms_velocity_in_s", "double", 0.0), Rule("z_rms_velocity_mm_s", "double", 0.0, True),
    Rule("temperature_f", "double", -459.67), Rule("temperature_c", "double", -273.15, True),
    Rule("x_rms_velocity_in_s", "double", 0.0), Rule("x_rms_velocity_mm_s", "double", 0.0, True),
    Rule("z_peak_acceleration_g", "double", None, True), Rule("x_peak_acceleration_g", "double", None, True),
    Rule("z_peak_vel_comp_freq_hz", "double", 0.0, True), Rule("x_peak_vel_comp_freq_hz", "double", 0.0, True),
    Rule("z_rms_acceleration_g", "double", 0.0, True), Rule("x_rms_acceleration_g", "double", 0.0, True),
    Rule("z_kurtosis", "double", None, True), Rule("x_kurtosis", "double", None, True),
    Rule("z_crest_factor", "double", None, True), Rule("x_crest_factor", "double", None, True),
    Rule("z_peak_velocity_in_s", "double"), Rule("z_peak_velocity_mm_s", "double", None, True),
    Rule("x_peak_velocity_in_s", "double"), Rule("x_peak_velocity_mm_s", "double", None, True),
    Rule("z_high_freq_rms_accel_g", "double", 0.0, True), Rule("x_high_freq_rms_accel_g", "double", 0.0, True),
    Rule("fault", "text"), Rule("rpm", "double", None, True),
)
FEATURES = [c.name for c in CONTRACT if c.feature]
#: (relation, trusted column, other column, factor, term): other = trusted * factor + term.
UNIT_RELATIONS = (
    ("temperature_c_to_temperature_f", "temperature_c", "temperature_f", 1.8, 32.0),
    ("x_peak_velocity_in_s_to_mm_s", "x_peak_velocity_mm_s", "x_peak_velocity_in_s", 1 / 25.4, 0.0),
    ("x_rms_velocity_in_s_to_mm_s", "x_rms_velocity_mm_s", "x_rms_velocity_in_s", 1 / 25.4, 0.0),
    ("z_peak_velocity_in_s_to_mm_s", "z_peak_velocity_mm_s", "z_peak_velocity_in_s", 1 / 25.4, 0.0),
    ("z_rms_velocity_in_s_to_mm_s", "z_rms_velocity_mm_s", "z_rms_velocity_in_s", 1 / 25.4, 0.0),
)
TYPES = {"long": T.LongType(), "double": T.DoubleType(), "instant": T.StringType(), "text": T.StringType()}
SCHEMA = T.StructType([T.StructField(c.name, TYPES[c.kind]) for c in CONTRACT])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """The whole contract: pinned types, header held against the schema, only the empty text is null, bad lines fail."""
    header = spark.read.option("header", True).csv(path).columns
    if header != schema.names:
        raise ValueError(f"header differs from the contract: {header}")
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv_column(spark: SparkSession, path: str, column: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """One column alone: the reader prunes the others, and so does not report errors in them."""
    return read_csv(spark, path, schema).select(column)


#: Readings derived from events, in SQL that Spark and DuckDB read alike; {text} is the instant as text.
#: Every 50th and 77th reading has a wrong redundant unit, every 200th comes twice, every 333rd twice with another speed.
DERIVED = """
SELECT id, {text} AS created_at, z / 25.4 + CASE WHEN id % 50 = 0 THEN 1.0 ELSE 0.0 END AS z_rms_velocity_in_s, z AS z_rms_velocity_mm_s,
  c * 1.8 + 32.0 + CASE WHEN id % 77 = 0 THEN 5.0 ELSE 0.0 END AS temperature_f, c AS temperature_c, x / 25.4 AS x_rms_velocity_in_s, x AS x_rms_velocity_mm_s,
  (id % 17) * 0.125 AS z_peak_acceleration_g, (id % 19) * 0.125 AS x_peak_acceleration_g, (id % 101) * 1.5 AS z_peak_vel_comp_freq_hz, (id % 103) * 1.5 AS x_peak_vel_comp_freq_hz,
  (id % 7) * 0.25 AS z_rms_acceleration_g, (id % 11) * 0.25 AS x_rms_acceleration_g, 3.0 + (id % 13) * 0.5 AS z_kurtosis, 3.0 + (id % 23) * 0.5 AS x_kurtosis,
  1.0 + (id % 5) * 0.75 AS z_crest_factor, 1.0 + (id % 9) * 0.75 AS x_crest_factor, z * 1.5 / 25.4 AS z_peak_velocity_in_s, z * 1.5 AS z_peak_velocity_mm_s,
  x * 1.5 / 25.4 AS x_peak_velocity_in_s, x * 1.5 AS x_peak_velocity_mm_s, (id % 29) * 0.0625 AS z_high_freq_rms_accel_g, (id % 31) * 0.0625 AS x_high_freq_rms_accel_g,
  fault, CAST(1000.0 + (id % 700) + turn AS DOUBLE) AS rpm, ts
FROM (
  SELECT event_id AS id, ts, event_type AS fault, coalesce(abs(value), 0.0) AS z, coalesce(abs(value), 0.0) * 0.5 AS x, 20.0 + (event_id % 30) AS c, 0.0 AS turn FROM events
  UNION ALL SELECT event_id, ts, event_type, coalesce(abs(value), 0.0), coalesce(abs(value), 0.0) * 0.5, 20.0 + (event_id % 30), 0.0 FROM events WHERE event_id % 200 = 0
  UNION ALL SELECT event_id, ts, event_type, coalesce(abs(value), 0.0), coalesce(abs(value), 0.0) * 0.5, 20.0 + (event_id % 30), 25.0 FROM events WHERE event_id % 333 = 0
) AS derived_rows
"""
SPARK_TEXT = "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'Z')"
DUCK_TEXT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"
DUCK_READINGS = f"readings AS ({DERIVED.format(text=DUCK_TEXT)})"


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived readings with the contract's columns, and the instant itself as `ts`."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = spark.sql(DERIVED.replace("FROM events", "FROM {events}").replace("{text}", SPARK_TEXT), events=events)
    doubles = {c.name for c in CONTRACT if c.kind == "double"}
    return made.select(*(F.col(c.name).cast("double" if c.name in doubles else TYPES[c.kind]).alias(c.name) for c in CONTRACT), "ts")
