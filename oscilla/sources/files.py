"""Audited sources and sinks: manifests, fingerprints, strict JSON, atomic publication."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strict_json import canonical_json
from ..plans.privacy import released


#: Schemes that tasks open by themselves, bytes that they hold of a file at once, and bytes of a file that is one value elsewhere.
OPENED, BUFFER, WHOLE = ("file", "hdfs", "s3", "gs"), 1 << 20, 1 << 26


def opened(uri: str) -> pa.NativeFile:
    """A file of one of these schemes, as Spark names it."""
    scheme, _, rest = uri.partition(":")
    store, inner = (afs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else afs.FileSystem.from_uri(uri)
    return store.open_input_file(inner)


def _streamed(uri: str) -> str:
    digest = hashlib.sha256()
    with opened(uri) as f:
        while piece := f.read(BUFFER):
            digest.update(piece)
    return digest.hexdigest()


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under a path, each hashed where it is read; no value and no task holds more of a file than BUFFER.

    What only Spark's readers open is one value up to WHOLE bytes, and beyond that is streamed through the driver's JVM, one file after another."""
    files, kinds = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), "path string, length long, sha256 string"
    fs = _hadoop(spark, path)[0]
    if fs.getUri().getScheme() in OPENED:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(_streamed, batch.column("path").to_pylist()), pa.string())], ["path", "length", "sha256"])

        return files.select("path", "length").mapInArrow(run, kinds)
    jvm, large = spark.sparkContext._jvm, []
    for r in files.where(F.col("length") > WHOLE).select("path", "length").collect():
        content = fs.open(jvm.org.apache.hadoop.fs.Path(r["path"]))
        try:
            large.append((r["path"], r["length"], jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(content)))
        finally:
            content.close()
    small = files.where(F.col("length") <= WHOLE).select("path", "length", F.sha2("content", 256).alias("sha256"))
    return small.unionByName(spark.createDataFrame(large, kinds)) if large else small


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, size_bytes, sha256) entries of a manifest {"schema_version": 1, "algorithm": "sha256", "files": [...]}; other versions and repeated names raise."""
    schema = "schema_version int, algorithm string, files array<struct<name: string, size_bytes: long, sha256: string>>"
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = doc.select("schema_version", "algorithm", F.size("files").alias("n"), F.size(F.array_distinct(F.transform("files", lambda f: f["name"]))).alias("names")).first()
    if head is None or head["schema_version"] != 1 or head["algorithm"] != "sha256" or head["n"] != head["names"]:
        raise ValueError("the manifest is not one of version 1 with distinct names")
    return doc.select(F.explode("files").alias("f")).select("f.*")


def audited(spark: SparkSession, path: str, manifest_path: str) -> DataFrame:
    """(name, problem) for files that the manifest lacks or describes otherwise, and for entries without a file."""
    seen = fingerprints(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("sha256").alias("digest"))
    joined = manifest(spark, manifest_path).join(seen, "name", "full_outer")
    problem = F.when(F.col("digest").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("length") != F.col("size_bytes"), "size").when(F.col("digest") != F.col("sha256"), "content")
    return joined.select("name", problem.alias("problem")).where("problem is not null")


def strict_object(text: str | None) -> str | None:
    """Why a text is no strict JSON object, or null if it is one: syntax, a repeated key, NaN or an infinity, another root."""
    if text is None:
        return "missing"

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise KeyError
        return dict(items)

    def constant(_):
        raise OverflowError

    try:
        root = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except KeyError:
        return "duplicate_key"
    except OverflowError:
        return "not_finite"
    except (ValueError, RecursionError):
        return "syntax"
    return None if isinstance(root, dict) else "root"


@F.pandas_udf(T.StringType())
def json_problem(text: pd.Series) -> pd.Series:
    """strict_object for a column; Spark's reader keeps the last of repeated keys silently."""
    return text.map(strict_object)


def checked_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table whose columns, in order, are the schema's; anything else raises before any row is read."""
    found = spark.read.parquet(path).schema
    if [(f.name, f.dataType) for f in found] != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"{path}: columns differ from the schema")
    return spark.read.schema(schema).parquet(path)


def null_violations(df: DataFrame, required: list[str]) -> DataFrame:
    """(column_name, nulls) of required columns that have any; one aggregate."""
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in required))
    return df.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*").where("nulls > 0")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, digest: str) -> bool:
    """Writes all tables and a manifest beside the target, then renames once. Returns False, and changes nothing, if the same digest is there; another one raises.

    Works on any file system that Spark reaches; readers see all or nothing where a rename is atomic."""
    fs, target = _hadoop(spark, path)
    if fs.exists(target):
        if spark.read.json(f"{path}/manifest").first()["digest"] == digest:
            return False
        raise FileExistsError(f"{path} holds another dataset")
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    counts = []
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{stage}/{name}")
        counts.append((name, spark.read.parquet(f"{stage}/{name}").count()))
    spark.createDataFrame([(digest, counts)], "digest string, tables array<struct<name: string, n: long>>").coalesce(1).write.json(f"{stage}/manifest")
    staged = _hadoop(spark, stage)[1]
    if not fs.rename(staged, target):
        fs.delete(staged, True)
        raise FileExistsError(f"{path} came into being meanwhile")
    return True


def write_changed(df: DataFrame, path: str, key: str, most: int | None = None) -> int:
    """Writes the rows of df as canonical JSON, a folder for each key, and only those that are new or differ from what is stored. Returns how many were written.

    Nothing is touched if nothing changed. Keys must be unique. `most`: raises if there are more rows, for reports of bounded size.
    Fields whose class is one of single records are refused."""
    spark = released(df, strict=False).sparkSession
    payload = canonical_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    new = df.select(F.col(key).cast("string").alias("key"), payload.alias("value"))
    if most is not None and new.limit(most + 1).count() > most:
        raise ValueError("too many rows for a report")
    fs, target = _hadoop(spark, path)
    if fs.exists(target):
        stored = spark.read.schema("value string, key string").format("text").load(path)
        new = new.join(stored, ["key", "value"], "left_anti")
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    new.write.parquet(stage)
    changed = spark.read.parquet(stage)
    n = changed.count()
    if n:
        changed.repartition("key").write.partitionBy("key").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)
    fs.delete(_hadoop(spark, stage)[1], True)
    return n


def append_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not stored: what an insert that ignores conflicts would add."""
    return new.join(stored.select(*keys), keys, "left_anti")


def render(rows: DataFrame, title: str) -> str:
    """A report of a small table as Markdown; raises beyond 1,000 rows, as reports are no exports, and for fields of single records."""
    found = released(rows, strict=False).limit(1001).collect()
    if len(found) > 1000:
        raise ValueError("too many rows for a report")
    head = "| " + " | ".join(rows.columns) + " |"
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found]
    return "\n".join([f"# {title}", "", head, "|" + "---|" * len(rows.columns), *body, ""])
