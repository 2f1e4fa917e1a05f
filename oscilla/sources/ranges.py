"""Files of any size bound to a manifest by ranges of their bytes, and checked before anything in them is parsed.

A file is cut into ranges of fixed size, dealt over tasks; each task streams and digests its own, so neither one value nor one task holds
a file, and a hot file is read by as many tasks as it has ranges. Digests are folded as a tree: ranges by blocks of FAN into files, files by
a hash of their names into BUCKETS, buckets into one root. Whoever holds the root can tell a changed manifest from a changed file, and a
changed file by range. Files whose names start with _ or . and empty ones are left out, as Spark's readers leave them out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What only Spark's readers open, not tasks by themselves, is read whole by them, so there, and only there, 2 GB are the end of a range's file.
from .files import BUFFER, OPENED, _hadoop, checked_parquet, opened

#: Bytes of a range; ranges of a block and buckets of names; most tasks; problems named in an error.
RANGE, FAN, BUCKETS, TASKS, NAMED = 1 << 26, 1 << 10, 1 << 12, 1 << 14, 5

_Result = TypeVar("_Result")


def _listed(spark: SparkSession, path: str, named: str) -> DataFrame:
    """(uri, name, length, content) of the files under a path; `content` costs nothing unless it is used."""
    fs, where = _hadoop(spark, path)
    base = fs.makeQualified(where).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0")
    own = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    inner = F.when(F.startswith(own, F.lit(f"{base}/")), F.substring(own, F.lit(len(base) + 2), F.length(own))).otherwise(F.element_at(F.split(own, "/"), -1))
    return files.select(F.col("path").alias("uri"), F.regexp_extract(inner, named, 1).alias("name"), "length", "content")


def _digested(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
            digest, left = hashlib.sha256(), size
            with opened(uri) as f:
                f.seek(start)
                while left and (piece := f.read(min(left, BUFFER))):
                    digest.update(piece)
                    left -= len(piece)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("length"), batch.column("start"), pa.array([size] * len(out), pa.int64()), pa.array(out, pa.string())], ["name", "length", "start", "size", "sha256"])


def digests(spark: SparkSession, path: str, size: int = RANGE, named: str = "^(.*)$") -> DataFrame:
    """(name, length, start, size, sha256) of every range of every file under a path, or of the one file that it names.

    `name` is the path below it, of which group 1 of `named` is kept where a writer adds the id of its run; names that aren't distinct raise."""
    files = _listed(spark, path, named)
    if not files.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError(f"{path}: names of files are not distinct")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))
    if _hadoop(spark, path)[0].getUri().getScheme() in OPENED:
        ranges = files.select("uri", "name", "length", F.explode(starts).alias("start"))
        # A stated number of tasks, of about RANGE bytes each, as adaptive execution would put all these short rows into one.
        total = ranges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.lit(size), F.col("length") - F.col("start"))).alias("bytes")).first()
        tasks = min(TASKS, max(1, min(total["n"], spark.sparkContext.defaultParallelism), (total["bytes"] or 0) // RANGE))
        return ranges.repartition(tasks, "name", "start").mapInArrow(lambda b: _digested(b, size), "name string, length long, start long, size long, sha256 string")
    ends = F.transform(starts, lambda s: F.struct(s.alias("start"), F.sha2(F.substring("content", (s + 1).cast("int"), F.lit(size)), 256).alias("sha256")))
    return files.select("name", "length", F.explode(ends).alias("r")).select("name", "length", "r.start", F.lit(size).cast("long").alias("size"), "r.sha256")


def _fold(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def _ordered(key: str, value: Column) -> Column:
    """The values of a group, in the order of their keys."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("value")))), lambda r: r["value"]), "\n")


def roots(ranges: DataFrame) -> DataFrame:
    """(name, length, root) of each file: a task folds the FAN ranges of a block, then one folds a file's blocks."""
    leaf = F.concat_ws(":", F.col("start").cast("string"), F.col("size").cast("string"), "sha256")
    blocks = ranges.groupBy("name", "length", F.floor(F.col("start") / (F.col("size") * FAN)).alias("block")).agg(_fold(_ordered("start", leaf)).alias("digest"))
    whole = blocks.groupBy("name", "length").agg(_ordered("block", F.col("digest")).alias("digests"))
    return whole.select("name", "length", _fold(F.col("name"), F.col("length").cast("string"), F.col("digests")).alias("root"))


def root(ranges: DataFrame) -> str:
    """One digest of names, lengths and bytes of all files. It alone reaches the driver; a bucket's files are folded in the order of their names."""
    buckets = roots(ranges).groupBy(F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).alias("bucket")).agg(_fold(_ordered("name", F.col("root"))).alias("digest"))
    return buckets.agg(_fold(_ordered("bucket", F.col("digest"))).alias("root")).first()["root"]


def seal(spark: SparkSession, path: str, manifest: str, size: int = RANGE, named: str = "^(.*)$") -> str:
    """Writes the ranges of all files under a path as a Parquet table at `manifest`, which must not be under it or exist, and returns their root."""
    digests(spark, path, size, named).write.parquet(manifest)
    return root(spark.read.parquet(manifest))


def problems(spark: SparkSession, path: str, manifest: str, expected: str, named: str = "^(.*)$") -> DataFrame:
    """(name, start, problem): files `missing`, `unlisted` or of another `length`, with start null, and ranges of another `content` in the others.

    Raises if the manifest isn't the one whose root is expected: its entries are then worth nothing."""
    listed = spark.read.parquet(manifest)
    if root(listed) != expected:
        raise ValueError(f"{manifest} has another root")
    sizes = listed.agg(F.min("size").alias("size")).first()["size"] or RANGE
    own, other = (df.select("name", "start", F.struct("length", "sha256").alias(n)) for df, n in ((listed, "own"), (digests(spark, path, sizes, named), "other")))
    files = listed.where("start = 0").select("name", F.col("length").alias("was")).join(_listed(spark, path, named).select("name", F.col("length").alias("found")), "name", "full_outer")
    whole = files.select("name", F.lit(None).cast("long").alias("start"), F.when(F.col("found").isNull(), "missing").when(F.col("was").isNull(), "unlisted").when(F.col("was") != F.col("found"), "length").alias("problem"))
    # Files of one length have the same ranges, so an inner join leaves out those of other lengths only.
    alike = (F.col("own.length") == F.col("other.length")) & (F.col("own.sha256") != F.col("other.sha256"))
    ranges = own.join(other, ["name", "start"]).select("name", "start", F.when(alike, "content").alias("problem"))
    return whole.unionByName(ranges).where("problem is not null")


def _demand(spark: SparkSession, path: str, manifest: str, expected: str, named: str) -> None:
    if wrong := problems(spark, path, manifest, expected, named).orderBy("name", "start").limit(NAMED).collect():
        raise ValueError(f"{path}: " + ", ".join(f"{r['problem']} of {r['name']}" + (f" from byte {r['start']}" if r["start"] is not None else "") for r in wrong))


def parquet(spark: SparkSession, path: str, manifest: str, expected: str, schema: T.StructType, size: int = RANGE, named: str = "^(.*)$") -> DataFrame:
    """A Parquet table whose bytes are those of the seal and whose columns are the schema's; raises before a footer is parsed otherwise."""
    _demand(spark, path, manifest, expected, named)
    return checked_parquet(spark, path, schema)


def consume(spark: SparkSession, path: str, manifest: str, expected: str, consumer: Callable[[str], _Result], named: str = "^(.*)$") -> _Result:
    """What `consumer` makes of the path; its bytes are held against the seal before and after, so a result from files that changed meanwhile isn't returned.

    The consumer must have run its jobs when it returns: a lazy frame would read after the second check."""
    _demand(spark, path, manifest, expected, named)
    result = consumer(path)
    _demand(spark, path, manifest, expected, named)
    return result
