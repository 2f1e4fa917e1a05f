"""Exact nearest neighbours that measure only what the triangle inequality can't rule out.

Training rows are dealt to the nearest of a bounded number of pivots; a cell's radius is the largest distance of its rows to
the pivot. First each query visits its nearest cells, as many as hold k rows, which bounds its k-th distance. Then it visits
every other cell that may hold a row within that bound: those whose pivot is no farther than bound plus radius. On clustered
vectors these are few; on vectors without structure they are all, and the result is the same either way.

Cells with many rows, such as one vector that a third of all rows repeat, are parted by row, and the queries that visit a part
by query, so that each two parts meet in a group of bounded size. A cell's rows are sent as often as its visitors fill
parts, a query as often as cells that it visits have parts.

Rows and queries without a vector take no part; vectors have one length and finite values. Equal distances go by the smaller
ref. Fewer than k rows give all of them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import vectors
from ..shared import cut
from .neighbours import BLOCK, TOP_K

#: Pivots at most, sampled rows for each, and room for rounding in comparisons of distances, in parts of what is compared and of the vectors' size.
PIVOTS, SAMPLED, ROOM, NEAR = 1024, 8, 1e-9, 1e-6


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, by matrix products."""
    square = (v * v).sum(1)[:, None] - 2 * (v @ pivots.T) + (pivots * pivots).sum(1)
    return np.sqrt(np.maximum(square, 0))


def _pivots(train: DataFrame, wanted: int) -> np.ndarray:
    """Centres of a bounded sample: rows drawn with odds that rise with the square of the distance to those drawn before, then moved twice to the means of what is nearest to them."""
    drawn = train.select("v").orderBy(F.xxhash64("ref")).limit(SAMPLED * wanted).collect()
    rows, rng = np.array([r["v"] for r in drawn], float), np.random.default_rng(1)
    if not len(rows):
        return rows
    centres, left = [rows[0]], ((rows - rows[0]) ** 2).sum(1)
    while len(centres) < wanted and left.max() > 0:
        centres.append(rows[rng.choice(len(rows), p=left / left.sum())])
        left = np.minimum(left, ((rows - centres[-1]) ** 2).sum(1))
    made = np.array(centres)
    for _ in range(2):
        own = _distances(rows, made).argmin(1)
        sizes = np.bincount(own, minlength=len(made))
        sums = np.zeros_like(made)
        np.add.at(sums, own, rows)
        made = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], made)
    return made


def celled(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds cell, the nearest pivot, and far, the distance to it."""
    names = train.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = vectors.matrix(pa.chunked_array([batch.column("v")]))
                cell = _distances(v, pivots).argmin(1)
                far = np.sqrt(((v - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=[*names, "cell", "far"])

    return train.mapInArrow(run, T.StructType([*train.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())]))


def _visits(queries: DataFrame, pivots: np.ndarray, counts: np.ndarray, radii: np.ndarray, k: int, first: bool) -> DataFrame:
    """(query_id, v, cell): the first cells of each query, or all others within its bound. queries: (query_id, v, bound)."""
    kind = to_arrow_schema(T.StructType([*queries.select("query_id", "v").schema.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                far = _distances(vectors.matrix(pa.chunked_array([part.column("v")])), pivots)
                order = np.argsort(far, 1, kind="stable")
                # As many of the nearest cells as hold k rows.
                upto = np.cumsum(counts[order], 1) - counts[order] < k
                begun = np.zeros(far.shape, bool)
                np.put_along_axis(begun, order, upto, 1)
                if first:
                    row, cell = np.nonzero(begun)
                else:
                    bound = np.array([math.inf if b is None else b for b in part.column("bound").to_pylist()])[:, None]
                    scale = np.sqrt((pivots * pivots).sum(1)).max() + far
                    row, cell = np.nonzero(~begun & (far - radii <= bound + ROOM * bound + NEAR * scale))
                own = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(own).cast(kind.field(0).type), part.column("v").take(own), pa.array(cell, pa.int32())], names=["query_id", "v", "cell"])

    return queries.mapInArrow(run, T.StructType([*queries.select("query_id", "v").schema.fields, T.StructField("cell", T.IntegerType())]))


def _measured(visits: DataFrame, rows: DataFrame, counts: np.ndarray, k: int, exclude_self: bool) -> DataFrame:
    """The k nearest of the rows in the cells that each query visits, cell part by cell part."""
    spark = rows.sparkSession
    asked = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # a row a cell
    parts = [max(1, -(-int(n) // BLOCK)) for n in counts]
    chunks = [-(-asked.get(c, 0) // BLOCK) for c in range(len(counts))]
    table = F.broadcast(spark.createDataFrame([(c, parts[c], chunks[c]) for c in range(len(counts)) if chunks[c]], "cell int, parts int, chunks int"))  # a row a cell
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ours = rows.join(table, "cell").select("cell", dealt("ref", "parts").alias("part"), every("chunks").alias("chunk"), "ref", "label", F.col("v").alias("x"))
    theirs = visits.join(table, "cell").select("cell", every("parts").alias("part"), dealt("query_id", "chunks").alias("chunk"), "query_id", F.col("v").alias("q"))
    kinds = T.StructType([T.StructField("query_id", visits.schema["query_id"].dataType), T.StructField("ref", rows.schema["ref"].dataType), T.StructField("label", rows.schema["label"].dataType), T.StructField("distance", T.DoubleType())])
    nothing = to_arrow_schema(kinds).empty_table()

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing
        left = left.sort_by("ref")
        found = vectors.nearest(vectors.matrix(right["q"]), vectors.matrix(left["x"]), k, *([right["query_id"].to_numpy(), left["ref"].to_numpy()] if exclude_self else []))
        spot, row = pa.array(found[0]), pa.array(found[1])
        return pa.table({"query_id": right["query_id"].take(spot), "ref": left["ref"].take(row), "label": left["label"].take(row), "distance": pa.array(found[2])})

    keys = ["cell", "part", "chunk"]
    return ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(near, kinds)


def _best(found: DataFrame, k: int) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "ref"))
    return found.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "ref", "label", "distance")


def nearest(queries: DataFrame, train: DataFrame, k: int = TOP_K, exclude_self: bool = False, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, ref, label, distance), one row with the pairs measured and all pairs). queries: (query_id, v); train: (ref, label, v).

    With exclude_self a query's own row, of the same id, is no neighbour."""
    spark = train.sparkSession
    train, queries = train.where("v is not null").select("ref", "label", "v"), queries.where("v is not null").select("query_id", "v")
    total, wanted = train.count(), k + exclude_self
    centres = _pivots(train, pivots or max(1, min(PIVOTS, math.isqrt(total))))
    if not total:
        centres = np.zeros((1, 0))
    rows = cut(celled(train, centres)) if total else train.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("far"))
    counts, radii = np.zeros(len(centres), np.int64), np.full(len(centres), -math.inf)
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect():  # a row a pivot
        counts[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    if not total:
        none = spark.createDataFrame([], T.StructType([queries.schema["query_id"], T.StructField("rank", T.IntegerType()), *train.select("ref", "label").schema.fields, T.StructField("distance", T.DoubleType())]))
        return none, spark.createDataFrame([(0, 0)], "measured long, pairs long")
    first = cut(_visits(queries.withColumn("bound", F.lit(None).cast("double")), centres, counts, radii, wanted, True))
    begun = cut(_measured(first, rows, counts, k, exclude_self))
    # The k-th of what was found; a query that found fewer has no bound.
    bounds = _best(begun, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("bound"))
    second = cut(_visits(queries.join(bounds, "query_id", "left"), centres, counts, radii, wanted, False))
    found = begun.unionByName(_measured(second, rows, counts, k, exclude_self))
    sizes = F.element_at(F.array(*(F.lit(int(n)) for n in counts)), F.col("cell") + 1)
    share = first.select("cell").unionByName(second.select("cell")).agg(F.coalesce(F.sum(sizes), F.lit(0)).cast("long").alias("measured")).crossJoin(queries.agg((F.count(F.lit(1)) * total).alias("pairs")))
    return _best(found, k), share
