"""What several operators share: the shared folder, plan sizes, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of labelled rows that no model may learn from: crc32(doc_id as text) mod FOLDS = 0.
FOLDS = 5


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as spark.checkpoint.dir names it.

    Only a local session without that setting gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="oscilla-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most between Spark and Python: with long texts, the default holds far more in each worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back.

    This cuts lineage: whatever executor is lost later, the rows stay as they are."""
    small_batches(spark)
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows of a narrow table that one partition holds easily.
NARROW_ROWS = 50_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Reliable checkpoint of a narrow table; Spark removes it when nothing refers to it. With about `rows` rows it gets as many partitions as they need, and so do the shuffles that read it."""
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(max(1, -(-rows // NARROW_ROWS)))
    shared_root(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int:
    """Bytes of the plan's inputs as Catalyst knows them; only numbers of partitions follow from it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    row = df.agg(F.count(F.lit(1)).alias("n")).first()
    return 512 * row["n"]


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo FOLDS; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS


def large_binary(column: pa.Array) -> pa.Array:
    """An Arrow text or binary column without nulls, with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary())
    return column.fill_null("" if pa.types.is_large_string(column.type) else b"")


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and the offsets of its values in them."""
    column = large_binary(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Runs of rows with about `most` bytes in `column`; a longer value is a run of its own, whole."""
    _, at = buffer_of(batch.column(column))
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield batch.slice(first, last - first)
        first = last


def scratch_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")



def without(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns that an operator is about to add: a clashing column gives way to the operator's own."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


#: The 256 remainders of CRC-32 in DuckDB SQL, as a common table t with the list crc.
SQL_CRC_TABLE = "t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"


def sql_crc(text: str) -> str:
    """CRC-32 of a text of ASCII letters in DuckDB SQL, where t is at hand."""
    return f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)), lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])), 4294967295)"
