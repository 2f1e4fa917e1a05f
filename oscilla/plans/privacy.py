"""Classes of fields that follow them to the sinks, and the one door by which rows of single records become figures that may leave.

A field's class is in its metadata, which Spark keeps under another name, through filters, joins and Parquet files, and loses in any
expression. So what is derived from a classified field is unclassified, and that counts as the strictest class: nothing is let out by
being computed. `summary` alone gives the class `aggregate`. It doesn't guard against differences of two summaries over nearly the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Classes that may leave, and those that may not. `category` values are from a closed set that names no record.
PUBLIC, PRIVATE = ("aggregate", "category"), ("record", "label")
#: Rows that a group needs for its figures to be told.
LEAST = 10
#: Figures over a group; the value of a single record, as a least or greatest one is, is none. Fixed names.
FIGURES: dict[str, Callable] = {"avg": F.avg, "count": F.count, "distinct": F.count_distinct, "stddev": F.stddev_samp, "sum": F.sum}


class Private(ValueError):
    """Fields of single records were about to leave."""


def classify(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """The same rows with a class for each column named; columns without one keep theirs, or stay unclassified."""
    if unknown := set(classes.values()) - {*PUBLIC, *PRIVATE} or set(classes) - set(df.columns):
        raise ValueError(f"unknown classes or columns: {sorted(unknown)}")
    for name, value in classes.items():
        df = df.withMetadata(name, df.schema[name].metadata | {"privacy": value})
    return df


def classes(df: DataFrame) -> dict[str, str | None]:
    """Class of each field, by its path; nested fields without one have that of the field around them, and can be stricter only."""
    found: dict[str, str | None] = {}

    def walk(kind: T.DataType, path: str, own: str | None) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                inner = f.metadata.get("privacy", own)
                found[f"{path}{f.name}"] = inner if own is None or own in PUBLIC or not path else own
                walk(f.dataType, f"{path}{f.name}.", found[f"{path}{f.name}"])
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, path, own)
        elif isinstance(kind, T.MapType):
            walk(kind.keyType, path + "key.", own)
            walk(kind.valueType, path + "value.", own)

    walk(df.schema, "", None)
    return found


def released(df: DataFrame, strict: bool = True) -> DataFrame:
    """df itself, if all its fields may leave. Unclassified ones may not, or, if not `strict`, may. A schema is read; no row is."""
    bad = [n for n, c in classes(df).items() if (c in PRIVATE if not strict else c not in PUBLIC)]
    if bad:
        raise Private(f"fields of single records: {sorted(bad)}")
    return df


def summary(df: DataFrame, keys: list[str], figures: dict[str, tuple[str, str]], least: int = LEAST) -> DataFrame:
    """(keys, n, suppressed, figures): figures by group, each name given as (one of FIGURES, column).

    Keys must be of class `category`; nulls are a key of their own. A group of fewer than `least` rows keeps its row, with null figures and a
    null n, and suppressed true. So does one whose figure stands on fewer values than that, as nulls don't count in it: that figure is null.
    Without keys there is one row, also for an empty table."""
    known = classes(df)
    if wrong := [k for k in keys if known[k] != "category"]:
        raise Private(f"no categories: {wrong}")
    if unknown := {f for f, _ in figures.values()} - set(FIGURES) or {"n", "suppressed"} & {*figures, *keys} or set(figures) & set(keys):
        raise ValueError(f"unknown figures or names in the way: {sorted(unknown)}")
    made = [F.count(F.lit(1)).alias("n")]
    for i, (f, _) in enumerate(figures.values()):
        made += [FIGURES[f](f"in{i}").alias(f"figure{i}"), F.count(f"in{i}").alias(f"values{i}")]
    # Columns get names of their own here, so that none of the caller's can clash with them.
    rows = df.select(*(F.col(k).alias(f"key{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"in{i}") for i, (_, c) in enumerate(figures.values())))
    rows = rows.groupBy(*(f"key{i}" for i in range(len(keys)))).agg(*made)
    enough, told = F.col("n") >= least, {"privacy": "aggregate"}
    out = [F.col(f"key{i}").alias(k, metadata={"privacy": "category"}) for i, k in enumerate(keys)]
    out += [F.when(enough, F.col("n")).alias("n", metadata=told), (~enough).alias("suppressed", metadata=told)]
    return rows.select(*out, *(F.when(enough & (F.col(f"values{i}") >= least), F.col(f"figure{i}")).alias(name, metadata=told) for i, name in enumerate(figures)))
