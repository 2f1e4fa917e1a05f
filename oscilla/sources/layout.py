"""Tables whose files depend on their rows alone: the same bytes from any number of partitions, in any order of arrival, on any run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering
from .files import _hadoop, fingerprints

#: Rows of a file. One row group should hold them, as where a writer ends a group depends on its memory.
FILE_ROWS = 1 << 20
#: A footer lists a column's encodings in an order that differs between JVMs, so each column has a single one: pages of version 2 name none for levels, and no dictionary comes with the data.
FORMAT = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "maxRecordsPerFile": 0}


def write(df: DataFrame, path: str, first: str, second: str, file_rows: int = FILE_ROWS) -> None:
    """Writes df as Parquet, one file in a folder part=k for each `file_rows` rows in the order of (first, second), nulls first.

    The pair must identify a row, else this raises before anything is written; df must not have a column named part, stretch or place. An
    empty table gives no file. The order is made in stretches, so no task orders all rows, and a task that is lost writes the same file again.
    df is computed several times, so what makes it must give the same rows each time."""
    _parts(df, first, second, file_rows).write.partitionBy("part").options(**FORMAT).parquet(path)


def write_lines(df: DataFrame, line: Column, path: str, first: str, second: str, file_rows: int = FILE_ROWS) -> None:
    """As `write`, but each row is a line of text, ended by a line feed; a null is an empty line."""
    rows = _parts(df, first, second, file_rows).select(F.coalesce(line.cast("string"), F.lit("")).alias("value"), "part")
    rows.write.partitionBy("part").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(path)


def _parts(df: DataFrame, first: str, second: str, file_rows: int) -> DataFrame:
    """Adds part, and brings each part's rows together in order."""
    if taken := {"part", "stretch", "place"} & set(df.columns):
        raise ValueError(f"columns in the way: {sorted(taken)}")
    if not df.groupBy(first, second).count().where("count > 1").isEmpty():
        raise ValueError(f"({first}, {second}) does not identify a row")
    placed = ordering.running_sum(ordering.stretched(df, first, second), F.lit(1), "place", first, second)
    parts = placed.withColumn("part", F.floor((F.col("place") - 1) / file_rows)).select(*df.columns, "part")
    return parts.repartition("part").sortWithinPartitions("part", first, second)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(part, length, sha256) of the files of a table; each is one value where it is hashed, as `file_rows` bounds it."""
    part = F.regexp_extract("path", r"/part=(\d+)/[^/]*\.parquet$", 1)
    return fingerprints(spark, path).select(part.alias("part"), "length", "sha256").where("part <> ''").withColumn("part", F.col("part").cast("long"))


def differing(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(part, equal): for each part of either table, whether both have it with equal bytes."""
    one, other = (digests(spark, p).select("part", F.struct("length", "sha256").alias(n)) for p, n in ((a, "one"), (b, "other")))
    return one.join(other, "part", "full_outer").select("part", F.coalesce(F.col("one") == F.col("other"), F.lit(False)).alias("equal"))


def publish(spark: SparkSession, make: Callable[[], DataFrame], path: str, first: str, second: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """Makes and writes the table twice, apart from each other, and renames one to path if all files have equal bytes. Returns `digests` of what is there.

    A path that exists, or two runs that differ, raise and leave nothing behind."""
    fs, target = _hadoop(spark, path)
    if fs.exists(target):
        raise FileExistsError(f"{path} holds another dataset")
    stages = [f"{path}.stage-{uuid.uuid4().hex}" for _ in range(2)]
    try:
        for stage in stages:
            write(make(), stage, first, second, file_rows)
        if wrong := differing(spark, *stages).where("not equal").orderBy("part").limit(5).collect():
            raise ValueError(f"two runs differ, first in parts {[r['part'] for r in wrong]}")
        if not fs.rename(_hadoop(spark, stages[0])[1], target):
            raise FileExistsError(f"{path} came into being meanwhile")
    finally:
        for stage in stages:
            fs.delete(_hadoop(spark, stage)[1], True)
    return digests(spark, path)
