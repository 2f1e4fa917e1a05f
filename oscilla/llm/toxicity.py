"""Toxicity: a linear classifier learnt from confirmed toxic texts and unlabelled text with the non-negative PU risk.

The risk is prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)) (Kiryo et al., 2017) with the logistic loss: rows without a
toxic label are never taken as clean. A document's features are which words, and first bytes of words, occur in it at all,
so a few toxic words count in a text of any length. Only features that toxic examples have clearly oftener than unlabelled
text are learnt, their weights are evidence for toxicity (never below zero), and an l1 step keeps the rest at zero.

Defined results: null and empty texts have no features and get the score of the bias alone; texts are scored whole; repeated
rows get equal scores; a null doc_id is scored but never learnt from; labels that contradict each other for one doc_id count
as toxic; of different texts under one doc_id one is learnt from; without a toxic example each score is 0; an empty table gives an empty table; extra columns pass through, and
columns named like the added ones give way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffer_of, fold, read, slices, without
from .features import stem_grams
from .words import U

#: Bounds of the training sample: documents of either kind (those with the smallest hash of doc_id), and features of each kind together.
TOXIC_ROWS = 4_000
UNLABELLED_ROWS = 10_000
TRAIN_FEATURES = 12_000_000
#: Full-gradient steps and their rate, the weight of the l1 step.
STEPS = 600
RATE = 0.5
L1 = 1e-5
#: A feature is learnt if so many toxic examples have it, and this share of them, at a rate above that of unlabelled text by so
#: many standard deviations and by this share of 1 / prior (which is the most that the prior allows).
LEAST, LEAST_SHARE = 3, 0.005
LIFT = 0.5
DEVIATIONS = 6.0
#: The score from which a text is toxic.
THRESHOLD = 0.5
#: Features of more than this share of unlabelled texts say nothing about copies; orders that are tried.
COMMON = 0.005
SKETCHES, LIKE = 8, 3
RUN_BYTES = 512 << 10


def _numbers(hashes: np.ndarray) -> np.ndarray:
    """Feature numbers: 32 bits, so that rare words of long clean texts hardly ever fall on a learnt feature."""
    return (hashes >> U(32)).astype(np.int64)


@dataclass
class Model:
    """Learnt features in rising order, their weights, the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.features & 0xFFFF] = True

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `numbers` learnt features stand, and which."""
        near = np.flatnonzero(self.seen[numbers & 0xFFFF])
        spot = np.searchsorted(self.features, numbers[near])
        spot[spot == len(self.features)] = 0
        hit = self.features[spot] == numbers[near] if len(self.features) else np.zeros(len(near), bool)
        return near[hit], spot[hit]


def present(texts: pa.Array) -> list[np.ndarray]:
    """The distinct feature numbers of each text."""
    raw, offsets = buffer_of(texts)
    hashes, owner = stem_grams(raw, offsets)
    numbers = _numbers(hashes)
    pairs = np.unique((owner << 32) | numbers)
    cuts = np.searchsorted(pairs, np.arange(len(offsets)) << 32)
    return [pairs[a:b] & 0xFFFFFFFF for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def margins(texts: pa.Array, model: Model) -> np.ndarray:
    """Bias and weights of the learnt features that occur; only these are made distinct."""
    raw, offsets = buffer_of(texts)
    hashes, owner = stem_grams(raw, offsets)
    at, which = model.find(_numbers(hashes))
    pairs = np.unique((owner[at] << 32) | which)
    return model.bias + np.bincount(pairs >> 32, model.weights[pairs & 0xFFFFFFFF], len(offsets) - 1)


class Rows:
    """Sparse rows of ones over the kept features."""

    def __init__(self, rows: list[np.ndarray], kept: np.ndarray) -> None:
        index, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, row in enumerate(rows if len(kept) else []):
            spot = np.minimum(np.searchsorted(kept, row), len(kept) - 1)
            hit = spot[kept[spot] == row]
            index.append(hit)
            owner.append(np.full(len(hit), i))
        self.n, self.width, self.index, self.owner = len(rows), len(kept), np.concatenate(index), np.concatenate(owner)

    def times(self, w: np.ndarray) -> np.ndarray:
        return w[-1] + np.bincount(self.owner, w[self.index], self.n)

    def gradient(self, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.index, g[self.owner], self.width), g.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def unlike(rows: list[np.ndarray], common: np.ndarray) -> list[np.ndarray]:
    """Rows without copies and near copies of earlier ones, so that a text copied many times does not vouch for its words.

    A row is like an earlier one if the smallest of its rarer features is the same under LIKE of SKETCHES orders (a min-hash)."""
    seen: list[set[int]] = [set() for _ in range(SKETCHES)]
    out = []
    for row in rows:
        rare = np.setdiff1d(row, common, assume_unique=True).astype(U)
        keys = [int(((rare * U(2 * k + 0x9E3779B1)) & U(0xFFFFFFFF)).min()) for k in range(SKETCHES)] if len(rare) else []
        if sum(k in s for k, s in zip(keys, seen, strict=False)) < LIKE:
            out.append(row)
        for k, s in zip(keys, seen, strict=False):
            s.add(k)
    return out


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Proximal Adagrad on the non-negative PU risk."""
    if not toxic or not unlabelled:
        return Model(np.empty(0, np.int64), np.empty(0), -35.0)
    other, count = np.unique(np.concatenate(unlabelled), return_counts=True)
    apart = unlike(toxic, other[count > COMMON * len(unlabelled)])
    found, seen = np.unique(np.concatenate(apart), return_counts=True)
    spot = np.minimum(np.searchsorted(other, found), max(0, len(other) - 1))
    rate = (np.where(other[spot] == found, count[spot], 0) + 1) / (len(unlabelled) + 1) if len(other) else np.full(len(found), 1 / (len(unlabelled) + 1))
    above = (seen - len(apart) * rate) / np.sqrt(len(apart) * rate * (1 - np.minimum(rate, 0.999)))
    kept = found[(seen >= max(LEAST, LEAST_SHARE * len(apart))) & (seen >= LIFT / prior * rate * len(apart)) & (above >= DEVIATIONS)]
    p, u = Rows(toxic, kept), Rows(unlabelled, kept)
    w = np.zeros(len(kept) + 1)
    w[-1] = np.log(prior / (1 - prior))
    total = np.full(len(w), 1e-8)
    for _ in range(STEPS):
        fp, fu = p.times(w), u.times(w)
        # Logistic loss of y is log(1 + exp(-y f)); its slope is -y * sigmoid(-y f).
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        slope_minus = u.gradient(_sigmoid(fu) / u.n) - p.gradient(prior * _sigmoid(fp) / p.n)
        if negative >= 0:
            g = p.gradient(-prior * _sigmoid(-fp) / p.n) + slope_minus
        else:
            g = -slope_minus
        total += g * g
        step = RATE / np.sqrt(total)
        w -= step * g
        w[:-1] = np.maximum(0, w[:-1] - step[:-1] * L1)
    used = w[:-1] > 0
    # A text without any learnt feature is never likelier toxic than any other text.
    return Model(kept[used], w[:-1][used], min(float(w[-1]), float(np.log(prior / (1 - prior)))))


def training_ids(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> DataFrame:
    """(doc_id, toxic) of the bounded training sample outside the held-out fold; `toxic` is 0 for a row of unlabelled text."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    free = docs.select("doc_id").where(fold(F.col("doc_id")) != 0)
    known = labels.where((F.col("toxic") == 1) & (fold(F.col("doc_id")) != 0)).select("doc_id").distinct()
    toxic = known.join(free.distinct(), "doc_id", "left_semi").orderBy(*order).limit(toxic_rows)
    return toxic.select("doc_id", F.lit(1).alias("toxic")).unionAll(free.distinct().orderBy(*order).limit(unlabelled_rows).select("doc_id", F.lit(0).alias("toxic")))


def class_prior(docs: DataFrame, labels: DataFrame) -> float:
    """Share of toxic rows among the labelled ones outside the held-out fold, and three standard errors or 7 % of it, if that is less: what unlabelled text is taken to hold.

    Too low a prior would count toxic words of unlabelled text as clean ones; the clamp of the risk bears one too high."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    row = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.avg("toxic").alias("p"), F.count(F.lit(1)).alias("n")).first()
    share, n = row["p"] or 0.0, max(1, row["n"])
    return min(0.9, max(0.001, share + min(3 * (share * (1 - share) / n) ** 0.5, 0.07 * share)))


def training_features(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> DataFrame:
    """(doc_id, toxic, index): the features of the bounded sample. A doc_id counts once of each kind, however many rows have it: with the least of their feature lists, combined before the shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", RUN_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("toxic").cast(pa.int32()), pa.array([x.astype("<u4").tobytes() for x in present(part.column("text"))], pa.binary())], names=["doc_id", "toxic", "index"])

    picked = training_ids(docs, labels, toxic_rows, unlabelled_rows)
    made = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInArrow(run, "doc_id long, toxic int, index binary")
    return made.groupBy("doc_id", "toxic").agg(F.min("index").alias("index"))


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, toxic_rows: int = TOXIC_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, features: int = TRAIN_FEATURES) -> Model:
    """One task fits over the bounded sample; the driver gets the learnt features and their weights alone.

    Documents come by the hash of doc_id; a kind's sample ends with the first one that would take it beyond `features` numbers,
    so no length is preferred."""
    prior = class_prior(docs, labels) if prior is None else prior

    def run(batches):
        rows, used, full = ([], []), [0, 0], [False, False]
        for batch in batches:
            for toxic, index in zip(batch.column("toxic").to_pylist(), batch.column("index"), strict=True):
                found = np.frombuffer(index.as_py(), "<u4")
                full[toxic] |= used[toxic] + len(found) > features
                if not full[toxic]:
                    rows[toxic].append(found)
                    used[toxic] += len(found)
        model = fit(rows[1], rows[0], prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.features.astype("<i8").tobytes()], pa.binary()), pa.array([model.weights.astype("<f8").tobytes()], pa.binary()), pa.array([model.bias])], names=["features", "weights", "bias"])

    sample = training_features(docs, labels, toxic_rows, unlabelled_rows).repartition(1).sortWithinPartitions("toxic", F.xxhash64("doc_id"), "doc_id")
    found = sample.mapInArrow(run, "features binary, weights binary, bias double").first()
    return Model(np.frombuffer(found["features"], "<i8"), np.frombuffer(found["weights"], "<f8"), found["bias"]) if found else fit([], [], prior)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """df's columns (or `keep`) and a score from 0 to 1; no shuffle. A model of a bounded sample is bounded too, and broadcast."""
    rest = without(df.select(*keep) if keep else df, name)
    columns, shared = rest.columns, df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, RUN_BYTES):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(_sigmoid(margins(part.column(text), shared.value)))], names=[*columns, name])

    return df.select(*dict.fromkeys([*columns, text])).mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())]))


def op6_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
