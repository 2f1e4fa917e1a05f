"""Vectors as arrays of doubles: expressions, and what groups of many vectors need."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    """Distance in double precision, summed in order."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def cosine_score(a: Column, b: Column) -> Column:
    """0.5 + cos / 2, held to 0..1; null where a vector is zero."""
    score = 0.5 + cosine(a, b) / 2
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def standardize(v: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(v, mean, lambda x, m: x - m), scale, lambda x, s: x / s)


def literal(v: Column) -> Column:
    """Text form [a,b,...] of a vector of whole or fixed-point values."""
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def from_literal(text: Column) -> Column:
    return F.from_json(text, "array<double>")


#: Queries whose distances are held at once, and the room for rounding of a product against an exact sum, in parts of the norms.
AT_ONCE, ROOM = 256, 1e-9


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of arrays of one length."""
    made = column.combine_chunks()
    return made.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(made), -1) if len(made) else np.empty((0, 0))


def nearest(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of each query, ties to the earlier row; with `own` and `ids`, none whose id is the query's own.

    Distances that are not numbers come last."""
    norms, who, rows, far = (x * x).sum(1), [], [], []
    for at in range(0, len(q), AT_ONCE):
        part = q[at : at + AT_ONCE]
        size = (part * part).sum(1)
        rough = size[:, None] - 2 * (part @ x.T) + norms
        rough[np.isnan(rough)] = np.inf
        if own is not None:
            same = ids == own[at : at + AT_ONCE, None]
            rough[same] = np.inf
        edge = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        edge = edge + ROOM * (size + np.nanmax(norms))
        for i in range(len(part)):
            near = np.flatnonzero(~(rough[i] > edge[i]))
            if own is not None:
                near = near[~same[i, near]]
            exact = np.sqrt(((x[near] - part[i]) ** 2).sum(1))
            best = np.argsort(exact, kind="stable")[:k]
            who.append(np.full(len(best), at + i)), rows.append(near[best]), far.append(exact[best])
    return np.concatenate(who), np.concatenate(rows), np.concatenate(far)
