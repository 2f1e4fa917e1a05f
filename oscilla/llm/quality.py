"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A document's features are the shares of its hashed n-grams of words and of word shapes, so length does not matter; a score
is one sparse dot product through the logistic function. Nothing but the text enters a score.

Defined results: null and empty texts have no features and get the score of the bias alone; texts are scored whole, however
long; repeated rows get equal scores; a null doc_id is scored but never learnt from; labels that contradict each other for
one doc_id count as the worse quality; of different texts under one doc_id one is learnt from; without any usable label each score is 0.5; an empty table gives an empty
table; extra columns pass through, and columns named like the added ones give way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffer_of, fold, read, slices, without
from .features import style_grams
from .words import U

#: Hash space, and the bounds of the training sample: labelled documents (those with the smallest hash of doc_id), and features of all of them together.
DIM = 1 << 18
TRAIN_ROWS = 10_000
TRAIN_FEATURES = 12_000_000
#: Passes over the sample, and the score from which a document is good.
EPOCHS = 6
THRESHOLD = 0.3
RUN_BYTES = 512 << 10


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss (McMahan et al., 2013)."""

    dim: int = DIM
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(self.dim + 1), np.zeros(self.dim + 1)

    def at(self, index: np.ndarray) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        """One example; the last coordinate is the bias."""
        index, value = np.append(index, self.dim), np.append(value, 1.0)
        w = self.at(index)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g

    def weights(self) -> np.ndarray:
        return self.at(np.arange(self.dim + 1)).astype(np.float32)


def _index(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(40)).astype(np.int64) & (DIM - 1)


def vectors(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: distinct feature numbers, and the feature's share of the n-grams of its kind, summed over kinds."""
    raw, offsets = buffer_of(texts)
    n = len(offsets) - 1
    parts = [[] for _ in range(n)]
    for hashes, owner in style_grams(raw, offsets):
        index, cuts = _index(hashes), np.searchsorted(owner, np.arange(n + 1))
        for i in range(n):
            if cuts[i] < cuts[i + 1]:
                found, count = np.unique(index[cuts[i] : cuts[i + 1]], return_counts=True)
                parts[i].append((found, count / (cuts[i + 1] - cuts[i])))
    made = []
    for part in parts:
        if not part:
            made.append((np.empty(0, np.int64), np.empty(0)))
            continue
        found, where = np.unique(np.concatenate([p[0] for p in part]), return_inverse=True)
        made.append((found, np.bincount(where, np.concatenate([p[1] for p in part]), len(found))))
    return made


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The dot product of each text's vector with the weights, and the bias; without building the vectors."""
    raw, offsets = buffer_of(texts)
    n = len(offsets) - 1
    total = np.full(n, float(weights[-1]))
    for hashes, owner in style_grams(raw, offsets):
        counts = np.bincount(owner, minlength=n)
        total += np.bincount(owner, weights[_index(hashes)], n) / np.maximum(counts, 1)
    return total


def training_vectors(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, label, index, value) of at most `most` labelled documents outside the held-out fold; the bound makes the broadcast safe.

    A doc_id counts once, however many rows have it: with the least of their vectors, combined before the shuffle."""
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", RUN_BYTES):
                made = vectors(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())],
                    names=["doc_id", "label", "index", "value"],
                )

    made = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInArrow(run, "doc_id long, label int, index binary, value binary")
    return made.groupBy("doc_id").agg(F.min("label").alias("label"), F.min(F.struct("index", "value")).alias("v")).select("doc_id", "label", "v.*")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, features: int = TRAIN_FEATURES) -> np.ndarray:
    """Weights and, last, the bias. One task updates over the bounded sample, in one fixed order; the driver gets the weights alone.

    Documents come by the hash of doc_id; the sample ends with the first one that would take it beyond `features` numbers, so no
    length is preferred."""

    def run(batches):
        index, value = np.empty(features, np.int32), np.empty(features, np.float32)
        spans, used, full = [], 0, False
        for batch in batches:
            for label, i, v in zip(batch.column("label").to_pylist(), batch.column("index"), batch.column("value"), strict=True):
                i, v = np.frombuffer(i.as_buffer(), "<i4"), np.frombuffer(v.as_buffer(), "<f4")
                full |= used + len(i) > features
                if not full:
                    index[used : used + len(i)], value[used : used + len(i)] = i, v
                    spans.append((used, used + len(i), label))
                    used += len(i)
        order, model = np.random.default_rng(7).permutation(len(spans)), Ftrl()
        for _ in range(EPOCHS):
            for k in order:
                a, b, label = spans[k]
                model.learn(index[a:b].astype(np.int64), value[a:b].astype(float), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().tobytes()], pa.binary())], names=["weights"])

    sample = training_vectors(docs, labels, most).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = sample.mapInArrow(run, "weights binary").first()
    return np.frombuffer(found["weights"], np.float32) if found else Ftrl().weights()


def score(df: DataFrame, weights: np.ndarray, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """df's columns (or `keep`) and a score from 0 to 1; no shuffle. The weights are of fixed size, and broadcast."""
    rest = without(df.select(*keep) if keep else df, name)
    columns, shared = rest.columns, df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, RUN_BYTES):
                made = 1.0 / (1.0 + np.exp(-np.clip(margins(part.column(text), shared.value), -35, 35)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(made)], names=[*columns, name])

    return df.select(*dict.fromkeys([*columns, text])).mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())]))


def op2_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
