"""Contracts of tables: structure, types, missing, infinite and out-of-domain values, allowed labels; staged, sanitised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import instants
from ..sources.readings import CONTRACT, TYPES, Rule

VIOLATION = "stage string, code string, column_name string, affected long"


def structure(columns: list[str], contract: tuple[Rule, ...] = CONTRACT) -> list[tuple[str, str, str, int]]:
    """Missing and unexpected columns, and a wrong order of the right ones; names alone, on the driver."""
    wanted = [c.name for c in contract]
    missing, extra = [c for c in wanted if c not in columns], [c for c in columns if c not in wanted]
    renamed = len(missing) == len(extra) and bool(missing) and all(columns[wanted.index(c)] not in wanted for c in missing if wanted.index(c) < len(columns))
    out = [("structure", "column_renamed" if renamed else "column_missing", c, 1) for c in missing]
    out += [] if renamed else [("structure", "column_unexpected", c, 1) for c in extra]
    return out or ([("structure", "column_order", "", 1)] if columns != wanted else [])


def dtypes(df: DataFrame, contract: tuple[Rule, ...] = CONTRACT) -> list[tuple[str, str, str, int]]:
    """Columns of another type than the contract's; nothing is coerced."""
    return [("dtype", "wrong_type", c.name, 1) for c in contract if df.schema[c.name].dataType != TYPES[c.kind]]


def outside(c: Rule) -> Column:
    """Whether a value that is there breaks its column's domain."""
    col = F.col(c.name)
    if c.kind == "double":
        low = col < c.minimum if c.minimum is not None else F.lit(False)
        return ~F.isnan(col) & (F.abs(col) != float("inf")) & low
    if c.kind == "instant":
        return instants.parse(col).isNull() & col.isNotNull()
    return F.trim(col) == "" if c.kind == "text" else F.lit(False)


def counted(df: DataFrame, stage: str, code: str, breaks: dict[str, Column]) -> DataFrame:
    """(stage, code, column, affected rows) where any; one aggregate over all columns."""
    rows = F.array(*(F.struct(F.lit(stage).alias("stage"), F.lit(code).alias("code"), F.lit(k).alias("column_name"), F.count_if(v).alias("affected")) for k, v in breaks.items()))
    return df.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*").where("affected > 0")


def values(df: DataFrame, contract: tuple[Rule, ...] = CONTRACT, allowed: list[str] | None = None) -> list[DataFrame]:
    """The data stages in order: missing (null and NaN apart), infinite, domain."""
    real = [c for c in contract if c.kind == "double"]
    missing = counted(df, "missing", "null", {c.name: F.col(c.name).isNull() for c in contract}).unionAll(counted(df, "missing", "nan", {c.name: F.isnan(c.name) for c in real}))
    infinite = counted(df, "infinite", "infinity", {c.name: F.abs(F.col(c.name)) == float("inf") for c in real})
    breaks = {c.name: outside(c) for c in contract}
    domain = counted(df, "domain", "outside_domain", breaks)
    if allowed is not None:
        texts = [c.name for c in contract if c.kind == "text"]
        domain = domain.unionAll(counted(df, "domain", "label_not_allowed", {c: ~F.col(c).isin(*allowed) for c in texts}))
    return [missing, infinite, domain]


def report(df: DataFrame, contract: tuple[Rule, ...] = CONTRACT, allowed: list[str] | None = None) -> DataFrame:
    """All violations of the first stage that has any; names and counts, never values. At most a few rows a column reach the driver."""
    spark = df.sparkSession
    for found in (lambda: structure(df.columns, contract), lambda: dtypes(df, contract)):
        if rows := found():
            return spark.createDataFrame(rows, VIOLATION)
    for stage in values(df, contract, allowed):
        if rows := [tuple(r) for r in stage.collect()]:
            return spark.createDataFrame(rows, VIOLATION)
    return spark.createDataFrame([], VIOLATION)
