"""Histogram sort: shards of near equal bytes along a key, found by exact counts below refined probes, then one exchange.

Rows are ordered by (doc_id, a number unique to the row), read as one long binary key. Round by round, the bytes and rows
below each probe are counted exactly, in one grouped sum over all partitions; probes are the edges of 2**BITS equal bins
inside every interval that is still open. An interval stays open while a splitter lies inside it or it holds more rows than
one task may rank. Splitter s is the first row with at least s/shards of all bytes before it, so each shard is within one
row of its share. Neighbouring bins of one shard that need no refinement are merged into runs by a running sum inside each
interval; the driver gets the runs and the open intervals, whose number is bounded by INTERVALS and the number of shards,
never the bins. Every row then reads its shard and its run from the key, and one exchange by run gives each row its slot; no
task ranks more than one run, and a key that many rows share is split by the row numbers like any other. Everything is
DataFrame code.

Defined results: a null text has size 8 and no crc (null); an empty one has size 8 and crc 0; a text of any length counts
with all its bytes and lies in one shard whole; null doc_ids come first; rows with equal doc_ids, and repeated rows, are dealt
each on its own, in the order of their row numbers; an empty table gives an empty table; extra columns pass through, and
columns named like the added ones give way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, shared_table, without

SHARDS = 24
#: log2 of the bins that an open interval is cut into, and rows that one task may rank.
BITS = 10
PART = 100_000
#: Bounds the intervals that are open at once, and so what the driver gets, whatever the number of rows: with more rows, a task ranks more.
INTERVALS = 4_000
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class Digit:
    """A piece of the key: `bits` bits of `a` (doc_id with its sign turned) or `b` (row number) from `shift` up."""

    column: str
    shift: int
    bits: int

    def prefix(self) -> tuple[Column, Column]:
        """The key above this digit; equal prefixes lie in one interval."""
        above = F.shiftrightunsigned(F.shiftrightunsigned(F.col(self.column), self.shift), self.bits)
        return (above, F.lit(0).cast("long")) if self.column == "a" else (F.col("a"), above)

    def value(self) -> Column:
        return F.shiftrightunsigned(F.col(self.column), self.shift).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")


def digits(low: int, high: int, most_b: int) -> list[Digit]:
    """Digits below the first bit in which two doc_ids can differ, then those of row numbers."""
    out = []
    for column, bits in (("a", (low ^ high).bit_length()), ("b", most_b.bit_length())):
        while bits > 0:
            take = min(BITS, bits)
            bits -= take
            out.append(Digit(column, bits, take))
    return out or [Digit("b", 0, 1)]


def refined(keyed: DataFrame, digit: Digit, opened: DataFrame, last: bool, total: int, shards: int, least: int, limit: int) -> DataFrame:
    """The runs and the open bins that `opened` intervals (x, y, rows_before, size_before) fall into: x, y, lowest and highest digit, what is before."""
    x, y = digit.prefix()
    binned = keyed.select(x.alias("x"), y.alias("y"), digit.value().alias("d"), "size").join(F.broadcast(opened), ["x", "y"])
    bins = binned.groupBy("x", "y", "rows_before", "size_before", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    # One interval's bins, 2**BITS of them, are what a task orders here.
    earlier = Window.partitionBy("x", "y").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    start, own_rows = F.col("size_before") + F.coalesce(F.sum("s").over(earlier), F.lit(0)), F.coalesce(F.sum("n").over(earlier), F.lit(0))
    bins = bins.select("x", "y", "d", "n", "s", start.alias("start"), own_rows.alias("own"), (F.col("rows_before") + own_rows).alias("before"))
    shard = F.expr(f"start * {shards} div {total}")
    # Rows of a bin may belong to different shards if its first and its last row can; no row has less than `least` bytes.
    crosses = F.expr(f"start * {shards} div {total} <> (start + s - {least}) * {shards} div {total}")
    more = F.lit(False) if last else (F.col("n") > 1) & ((F.col("n") > limit) | crosses)
    bins = bins.select("*", shard.cast("int").alias("shard"), more.alias("more"))
    run = F.when(F.col("more"), -F.col("d") - 1).otherwise(F.floor(F.col("own") / limit))
    return bins.groupBy("x", "y", "shard", "more", run.alias("run")).agg(F.min("d").alias("low"), F.max("d").alias("high"), F.min("before").alias("before"), F.min("start").alias("start"))


def deal(df: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, part: int = PART) -> DataFrame:
    """df's rows (or only the columns to carry) with size, text_crc32, law, shard, slot and grown_shard."""
    spark = df.sparkSession
    kept = without(df.select(*carry) if carry else df, *ADDED)
    size = F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long")) + 8
    number, turn = F.monotonically_increasing_id(), F.lit(-(1 << 63))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("row"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.coalesce(F.col(doc_id).cast("long"), turn).bitwiseXOR(turn).alias("a"), number.alias("b"))
    # Written once: row numbers must be the same in every round and after the loss of any executor.
    rows = shared_table(spark, rows, "sharding")
    keyed = rows.select("a", "b", "size")
    signed = F.col("a").bitwiseXOR(turn)
    whole = keyed.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.min("size").alias("least"), F.min(signed).alias("low"), F.max(signed).alias("high"), F.max("b").alias("b")).first()
    total, half = whole["s"] or 1, 1 << 63
    levels = digits((whole["low"] or 0) % (1 << 64) ^ half, (whole["high"] or 0) % (1 << 64) ^ half, whole["b"] or 0)

    # The key's bits above the first digit are the same in all rows.
    x, y = levels[0].prefix()
    edge = keyed.select(x.alias("x"), y.alias("y")).first()
    opened = [(edge["x"], edge["y"], 0, 0)] if edge else []
    runs: list[list] = []
    for at, digit in enumerate(levels):
        if not opened:
            break
        ours = spark.createDataFrame(opened, "x long, y long, rows_before long, size_before long")
        # INTERVALS open ones, about as many runs, and some for each shard.
        found = refined(keyed, digit, ours, at + 1 == len(levels), total, shards, whole["least"], max(part, whole["n"] // INTERVALS)).collect()
        runs.append([r for r in found if not r["more"]])
        opened = []
        for r in found:
            if r["more"]:
                deeper = levels[at + 1]
                if digit.column == deeper.column:
                    up = ((r["x"] if digit.column == "a" else r["y"]) << digit.bits) | r["low"]
                    up = up - (1 << 64) if up >= half else up
                    key = (up, 0) if digit.column == "a" else (r["x"], up)
                else:
                    # The whole of `a` is known: what is above this level, then its digit; row numbers begin with the bits above their first digit.
                    up = (r["x"] << digit.bits) | r["low"]
                    key = (up - (1 << 64) if up >= half else up, 0)
                opened.append((*key, r["before"], r["start"]))

    # Where each shard begins, in rows: the slot of a row is its rank less that.
    first: dict[int, int] = {}
    for r in sorted((r for level in runs for r in level), key=lambda r: r["before"]):
        first.setdefault(r["shard"], r["before"])
    placed = rows
    chosen: list[tuple[Column, Column, Column]] = []
    for at, (digit, level) in enumerate(zip(levels, runs, strict=False)):
        if not level:
            continue
        table = spark.createDataFrame([(r["x"], r["y"], r["low"], r["high"], r["shard"], r["before"] - first[r["shard"]], r["before"]) for r in level], f"x{at} long, y{at} long, low{at} int, high{at} int, shard{at} int, base{at} long, place{at} long")
        x, y = digit.prefix()
        placed = placed.join(F.broadcast(table), (x == F.col(f"x{at}")) & (y == F.col(f"y{at}")) & digit.value().between(F.col(f"low{at}"), F.col(f"high{at}")), "left")
        chosen.append((F.col(f"shard{at}"), F.col(f"base{at}"), F.col(f"place{at}")))
    if not chosen:
        chosen = [(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))]
    shard, base, place = (F.coalesce(*(c[k] for c in chosen)) for k in range(3))
    own = F.row_number().over(Window.partitionBy("place").orderBy(F.shiftrightunsigned("a", 1), F.col("a").bitwiseAND(F.lit(1)), "b")) - 1
    placed = placed.select("row", "size", "crc", "a", "b", shard.alias("shard"), base.alias("base"), place.alias("place"))
    return placed.select("row.*", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("base") + own).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The same in DuckDB for distinct doc_ids: shares of the bytes before a row. The table of the checksum follows from its polynomial.
ORACLE = """
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), b AS (
  SELECT doc_id, text, hex(encode(text)) AS h FROM documents
), c AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size,
    CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])), 4294967295) END AS text_crc32
  FROM b, t
), s AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(size) OVER () AS total FROM c
), p AS (SELECT *, (start * 24 // total)::INT AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM p
"""


def op1_sharding_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return deal(read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
