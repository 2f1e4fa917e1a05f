"""Units of work over tables in a shared folder: numbered generations, snapshot reads, conflicts and rollback.

A store is a folder of Parquet parts and a log. Entry n of the log is generation n: for each table its keys, its schema and
the parts that it consists of, oldest first. A unit of work reads one generation, writes parts that no entry names yet, and
commits them for all its tables by creating entry n + 1, which succeeds for one writer only: where the entry is there
already, the unit is stale. Without a commit nothing names its parts, which is the whole of a rollback; what it leaves is
removed by `sweep`. Tables are merged on reading, the latest row of a key wins, and `compact` writes that state as one part.

Creating an entry is atomic where the file system's exclusive create is (HDFS, conditional writes of object stores)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GENERATION, GONE = "_generation", "_gone"
#: Changes of one unit at most.
CHANGES = 1000


class Conflict(RuntimeError):
    """Another unit has committed since this one began."""


class Store:
    """Tables under one path; `spark` reads and writes them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entry(self, n: int) -> str:
        return f"{self.path}/log/{n:012}.json"

    def _create(self, n: int, entry: dict) -> None:
        data = json.dumps(entry, sort_keys=True).encode()
        try:
            out = self._fs.create(self._fs_path(self._entry(n)), False)
        except Exception as e:
            if self._fs.exists(self._fs_path(self._entry(n))):
                raise Conflict(f"generation {n} is there already") from e
            raise
        out.write(data)
        out.close()

    def generation(self) -> int:
        """The newest one; 0 before the first commit."""
        log = self._fs_path(f"{self.path}/log")
        names = [s.getPath().getName() for s in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return max((int(n[:12]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def entry(self, n: int) -> dict:
        """What generation n names."""
        return json.loads(self.spark.read.text(self._entry(n), wholetext=True).first()["value"]) if n else {}

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        """The rows of a table in one generation, whatever is committed meanwhile."""
        found = self.entry(self.generation() if generation is None else generation)[table]
        return _merged(self._parts(found), found["keys"])

    def _parts(self, found: dict) -> DataFrame:
        return self.spark.read.schema(found["schema"]).parquet(*(f"{self.path}/{p}" for p in found["parts"]))

    def unit(self) -> Unit:
        return Unit(self)

    def sweep(self) -> int:
        """Removes parts that no entry names, and tells how many; only when no unit is at work."""
        named = {p for n in range(1, self.generation() + 1) for t in self.entry(n).values() for p in t["parts"]}
        data, removed = self._fs_path(f"{self.path}/data"), 0
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f"data/{status.getPath().getName()}" not in named:
                removed += self._fs.delete(status.getPath(), True)
        return removed


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key, without those that are gone."""
    rest = [c for c in rows.columns if c not in (*keys, GENERATION)]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), GENERATION).alias("row"))
    return latest.where(f"not row.{GONE}").select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest if c != GONE))


class Unit:
    """Changes to tables that are committed together. As a context it rolls back what is not committed."""

    def __init__(self, store: Store) -> None:
        self.store, self.base = store, store.generation()
        self.tables = store.entry(self.base)
        self.changes, self.closed = 0, False

    def __enter__(self) -> Unit:
        return self

    def __exit__(self, *_: object) -> None:
        self.closed = True

    def read(self, table: str) -> DataFrame:
        """The table as it was when the unit began, with the unit's own changes."""
        found = self.tables[table]
        return _merged(self.store._parts(found), found["keys"])

    def upsert(self, table: str, rows: DataFrame, keys: list[str], gone: Column | None = None) -> None:
        """Adds rows or replaces those with their keys; where `gone` holds, they go. A key that comes twice is an error of the caller's."""
        self._write(table, rows, keys, gone)

    def compact(self, table: str) -> None:
        """Writes the table's state as one part."""
        found = self.tables[table]
        self.tables = self.tables | {table: found | {"parts": []}}
        self._write(table, _merged(self.store._parts(found), found["keys"]), found["keys"], None)

    def _write(self, table: str, rows: DataFrame, keys: list[str], gone: Column | None) -> None:
        if self.closed or self.changes == CHANGES:
            raise RuntimeError("the unit of work is over")
        before = self.tables.get(table, {"parts": []})
        # Changes of one unit count in their order.
        made = rows.withColumn(GONE, F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)).withColumn(GENERATION, F.lit((self.base + 1) * CHANGES + self.changes).cast("long"))
        if before["parts"] and (before["keys"], before["schema"]) != (keys, _ddl(made)):
            raise ValueError(f"{table} has other keys or columns")
        part = f"data/{table}-{uuid.uuid4().hex}"
        made.write.parquet(f"{self.store.path}/{part}")
        self.tables = self.tables | {table: {"keys": keys, "schema": _ddl(made), "parts": [*before["parts"], part]}}
        self.changes += 1

    def commit(self) -> int:
        """The new generation; Conflict if another unit came first."""
        if self.closed:
            raise RuntimeError("the unit of work is over")
        self.closed = True
        if not self.changes:
            return self.base
        self.store._create(self.base + 1, self.tables)
        return self.base + 1


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def swap(unit: Unit, table: str, keys: list[str], commands: DataFrame, version: str = "version", expected: str = "expected", order: str = "command") -> DataFrame:
    """Compare and swap: of each key's commands the first counts, and is applied if it expects the key's version (0 for a key that is not there); the version rises by one.

    commands: keys, the table's other columns, `expected` and `order`. Returns keys, `order` and outcome of every command: applied, stale, or behind, for those after the first."""
    rest = [c for c in commands.columns if c not in (*keys, expected, order)]
    known = unit.read(table).select(*keys, version) if table in unit.tables else commands.select(*keys).limit(0).withColumn(version, F.lit(0).cast("long"))
    first = commands.groupBy(*keys).agg(F.min(order).alias("first_"))
    judged = commands.join(first, keys).join(known, keys, "left").withColumn("now_", F.coalesce(version, F.lit(0)))
    outcome = F.when(F.col(order) != F.col("first_"), "behind").when(F.col(expected) == F.col("now_"), "applied").otherwise("stale")
    judged = judged.withColumn("outcome", outcome)
    unit.upsert(table, judged.where("outcome = 'applied'").select(*keys, *rest, (F.col("now_") + 1).cast("long").alias(version)), keys)
    return judged.select(*keys, order, "outcome")
