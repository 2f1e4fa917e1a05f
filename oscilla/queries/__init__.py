"""Registered queries: thin applications of the operators to the tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Register:
    """Queries, their SQL, and the inventory rows that each one exercises."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}
        self.covers: dict[str, str] = {}

    def __call__(self, covers: str, sql: str | None = None):
        def add(f):
            self.queries[f.__name__], self.covers[f.__name__] = f, covers
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
