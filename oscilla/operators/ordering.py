"""A global order in bounded pieces: lags, running sums and last values over all rows without one task for all.

Rows are cut into stretches at splitters, pairs of the two order columns drawn from a sample, so stretches follow the density
of the rows: a dense hour has many, a quiet month one, and a heavy value of the first column is split by the second. Windows
work inside stretches, and one row a stretch carries what passes over their edges. With SAMPLES sampled rows for each stretch
its size is within a few tenths of the mean; only rows equal in both columns can't be parted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stretch about (none has twice as many), rows at least where more stretches only give idle cores work, and sampled rows for each stretch.
STRETCH_ROWS, LEAST_ROWS, SAMPLES = 1 << 21, 1 << 16, 64


def splitters(df: DataFrame, first: str, second: str, stretches: int, total: int) -> list[tuple]:
    """About stretches - 1 pairs, in order, that part the rows evenly; a sample is ordered, and one row of it for each stretch reaches the driver."""
    if stretches < 2:
        return []
    share = min(1.0, SAMPLES * stretches / total)
    step = max(1, int(share * total / stretches))
    drawn = df.select(F.col(first).alias("a"), F.col(second).alias("b")).where("a is not null and b is not null").sample(share, seed=11)
    ordered = drawn.repartitionByRange(max(1, stretches // 1024), "a", "b").sortWithinPartitions("a", "b").withColumn("place", F.monotonically_increasing_id() % (1 << 33) % step)
    return [(r["a"], r["b"]) for r in ordered.where(F.col("place") == step - 1).select("a", "b").collect()]


def _values(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=object if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else None)


def stretched(df: DataFrame, first: str, second: str, rows: int | None = None) -> DataFrame:
    """Adds `stretch`, numbers that rise in the order of (first, second), nulls first."""
    rows, total = rows or STRETCH_ROWS, df.count()
    cuts = splitters(df, first, second, max(-(-total // rows), min(df.sparkSession.sparkContext.defaultParallelism, total // LEAST_ROWS)), total)
    if not cuts:
        return df.withColumn("stretch", F.lit(0).cast("long"))
    lows, highs = (_values(pa.array(list(c))) for c in zip(*cuts, strict=True))

    def place(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a), np.int64)
        known = np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False))
        values = _values(a.take(pa.array(known)))
        low, high = np.searchsorted(lows, values, "left"), np.searchsorted(lows, values, "right")
        out[known] = low
        # Rows with a splitter's own first value go on by the second; a null there comes before all.
        tied = np.flatnonzero((low < high) & b.is_valid().to_numpy(zero_copy_only=False)[known])
        seconds = _values(b.take(pa.array(known[tied])))
        for k in np.unique(low[tied]):
            here = low[tied] == k
            own = highs[k : high[tied][here][0]]
            out[known[tied[here]]] = k + np.searchsorted(own, seconds[here], "right")
        return pa.array(out)

    return df.withColumn("stretch", F.arrow_udf(place, "long")(first, second))


def _carried(edges: DataFrame, value: Column, name: str, rising: bool = True) -> DataFrame:
    """(stretch, name): `value` over the stretches before each one, of which there is one row each."""
    order = F.col("stretch") if rising else F.col("stretch").desc()
    return edges.select("stretch", value.over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)).alias(name))


def lagged(df: DataFrame, first: str, second: str, name: str, rows: int | None = None) -> DataFrame:
    """Adds `name`, the value of `first` in the row before, null for the first row; and stretch."""
    cut = stretched(df, first, second, rows)
    edges = _carried(cut.groupBy("stretch").agg(F.max(first).alias("edge")), F.max("edge"), "edge_before")
    inside = Window.partitionBy("stretch").orderBy(first, second)
    return cut.join(edges, "stretch").withColumn(name, F.coalesce(F.lag(first).over(inside), F.col("edge_before"))).drop("edge_before")


def running_sum(df: DataFrame, value: Column, name: str, first: str, second: str) -> DataFrame:
    """Adds the sum of `value` over all rows up to each. df has stretch."""
    inside = Window.partitionBy("stretch").orderBy(first, second).rowsBetween(Window.unboundedPreceding, 0)
    before = _carried(df.groupBy("stretch").agg(F.sum(value).alias("edge")), F.sum("edge"), "edge_before")
    return df.withColumn(name, F.sum(value).over(inside)).join(before, "stretch").withColumn(name, F.col(name) + F.coalesce("edge_before", F.lit(0))).drop("edge_before")


def latest(df: DataFrame, value: Column, name: str, order: list[Column], rising: bool = True) -> DataFrame:
    """Adds the last `value` that is not null among the rows up to each, by rising `order`. df has stretch, whose numbers rise with
    the order, or fall if not `rising`."""
    inside = Window.partitionBy("stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = df.groupBy("stretch").agg(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias("edge"))
    before = _carried(ends, F.last("edge", ignorenulls=True), "edge_before", rising)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(inside)).join(before, "stretch").withColumn(name, F.coalesce(name, "edge_before")).drop("edge_before")
