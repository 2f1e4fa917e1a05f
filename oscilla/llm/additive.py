"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one codeword from each of CODEBOOKS full-dimensional codebooks. Codebooks start as
residual k-means and are then refitted by least squares to codes found by beam search; all vectors are encoded by beam
search and keep the squared norm of their approximation. A query's table of inner products with all codewords scores a
vector by CODEBOOKS lookups: |x|^2 - 2 <q, x>. The best share of each block is reranked by exact distances, at any size.

Vectors stand in inverted lists by their nearest coarse centroid, and a query looks into the lists nearest to it. How many
these are, and what share of them is reranked, is measured, not assumed: the exact neighbours of CALIBRATION queries
show how far down the order of lists, and of lookup scores in a list, neighbours stand (SHARE is the least share). Vectors without structure thus make a query look into most lists, and clusters
into few. Lists that hold fewer than k rows between them are followed by further ones.

An exact check follows, as no sample speaks for every query. A row keeps how far it is from its approximation and a list how
far it reaches, so by the triangle inequality a list, or a row by its lookup score, that can't come nearer than the k-th found
is left; all others are measured. Nothing is missed, then, whatever the vectors are like. Clusters leave little to check;
vectors without structure leave all pairs of a query and a row to it.

A group is one part of a list and one part of the queries that look into it, both of bounded size, and hands on at most k
rows a query.

Defined results: vectors that are null, all zero, of another dimension than most, or hold null, NaN or infinite components
take no part, neither as query nor as candidate; nor do rows without vec_id; rows equal in vec_id and vector count once;
different vectors under one vec_id are candidates each, and a query of its own each, under that id; equal distances go to the
smaller vec_id; with fewer than k candidates all are returned; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, shared_table

CODEBOOKS = 16
WORDS = 256
BEAM = 8
ROUNDS = 2
#: Vectors that codebooks and centroids are fitted on: those with the smallest hash of vec_id.
SAMPLE = 8_000
#: Inverted lists at most, and the rows of one, about, below that.
LISTS, LIST_ROWS = 1024, 1024
#: Queries that show how many lists to look into and how much of them to rerank; the share of their neighbours that these lists, and the reranked part, must hold.
CALIBRATION, IN_LISTS, IN_SHARE = 128, 0.98, 0.95
#: The part of a block that is reranked at least, counted in distinct codes, and k + 1 of them.
SHARE = 0.04
NEIGHBOURS = 10
EVERY = 100
#: Vectors of a part of a list, and queries that meet it at once.
BLOCK = 8192
QUERY_BLOCK = 4096
#: Rounding of a lookup score, as a part of the sum of its terms' sizes (18 roundings of 2**-24 make 1.1e-6); of products and of distances in double precision.
ROUGH, FINE = 2e-6, 1e-9


def _assign(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(1) - 2 * (x @ words.T), axis=1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    words = x[rng.permutation(len(x))[:k]]
    if len(words) < k:
        words = np.concatenate([words, np.zeros((k - len(words), x.shape[1]))])
    for _ in range(rounds):
        code = _assign(x, words)
        count = np.bincount(code, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, code, x)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)])
    return words


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The codes of each row: codebook by codebook, the `beam` best partial sums are kept."""
    n, (m, k, d) = len(x), books.shape
    flat = books.reshape(m * k, d)
    cross = flat @ flat.T  # inner products of all codewords
    inner = x @ flat.T
    loss = np.zeros((n, 1))
    codes = np.zeros((n, 1, 0), np.int64)
    for j in range(m):
        own = slice(j * k, (j + 1) * k)
        # |x - s - c|^2 = |x - s|^2 - 2 <x, c> + 2 <s, c> + |c|^2
        step = loss[:, :, None] + (np.diag(cross)[own] - 2 * inner[:, own])[:, None, :]
        for i in range(j):
            step += 2 * cross[i * k + codes[:, :, i], own]
        step = step.reshape(n, -1)
        keep = min(beam, step.shape[1])
        best = np.argpartition(step, keep - 1, axis=1)[:, :keep]
        loss = np.take_along_axis(step, best, 1)
        parent = best // k
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), (best % k)[:, :, None]], axis=2)
    return codes[np.arange(n), np.argmin(loss, 1)]


def fit(x: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (codebooks, words, dimension) for a bounded sample."""
    rng = np.random.default_rng(11)
    k = max(1, min(words, len(x)))
    rest, books = x.copy(), []
    for _ in range(codebooks):
        book = _k_means(rest, k, rng)
        rest = rest - book[_assign(rest, book)]
        books.append(book)
    books = np.stack(books)
    for _ in range(rounds):
        codes = np.concatenate([beam_encode(part, books) for part in np.array_split(x, max(1, len(x) // 512))])
        # Least squares: the codes' indicator matrix has `codebooks` ones a row, so its Gram matrix is counts of pairs.
        spots = codes + np.arange(codebooks) * k
        gram = np.zeros((codebooks * k, codebooks * k))
        right = np.zeros((codebooks * k, x.shape[1]))
        for i in range(codebooks):
            np.add.at(right, spots[:, i], x)
            for j in range(codebooks):
                np.add.at(gram, (spots[:, i], spots[:, j]), 1.0)
        books = np.linalg.solve(gram + 1e-3 * np.eye(len(gram)), right + 1e-3 * books.reshape(-1, x.shape[1])).reshape(books.shape)
    return books


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(books.shape[0]))


def lookups(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The lookup score of each row for each query: the squared distance to its approximation, less the query's own norm."""
    m, k, d = books.shape
    tables = (-2 * (queries @ books.reshape(m * k, d).T)).astype(np.float32).reshape(len(queries), m, k)
    score = np.tile(norms.astype(np.float32), (len(queries), 1))
    for j in range(m):
        score += tables[:, j][:, codes[:, j]]
    return score


def nearest(q: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the k nearest rows by exact distance, none of its own id, ties to the smaller id."""
    out = []
    for i in range(len(q)):
        rows = np.flatnonzero(ids != own[i])
        distance = ((x[rows] - q[i]) ** 2).sum(1)
        if len(rows) > 4 * k:
            edge = np.partition(distance, k - 1)[k - 1]
            keep = distance <= edge * (1 + 1e-9)
            rows, distance = rows[keep], distance[keep]
        out.append(rows[np.lexsort((ids[rows], np.sqrt(distance)))[:k]])
    return out


def reranked(q: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, k: int, share: float, scaled: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query the k nearest rows of those that the lookup scores propose; `scaled`: the queries as the codebooks have them, if not as they are.

    Of equal vectors only the smallest ids can be among the nearest; the shortlist counts distinct codes, so that copies take one place."""
    first, equal = groups(x + 0.0)
    codes, norms = codes[first][equal], norms[first][equal]
    kept = smallest(equal, k + 1)
    first, code = groups(codes[kept])
    most = min(len(first), max(k + 1, int(np.ceil(share * len(first)))))
    out, scaled = [], q if scaled is None else scaled
    for at in range(0, len(q), 64):
        score = lookups(scaled[at : at + 64], books, codes[kept][first], norms[kept][first])
        near = np.argpartition(score, most - 1, axis=1)[:, :most]
        for i, chosen in enumerate(near):
            taken = np.zeros(len(first), bool)
            taken[chosen] = True
            rows = kept[taken[code]]
            out.append(rows[nearest(q[at + i : at + i + 1], own[at + i : at + i + 1], ids[rows], x[rows], k)[0]])
    return out


def certified(q: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, gaps: np.ndarray, model: Model, k: int, best: list[np.ndarray], limit: np.ndarray) -> list[np.ndarray]:
    """For each query the k nearest rows of all, but for such as are beyond its limit: what lookup scores can't rule out against the best found is measured.

    gaps: how far each row is from its approximation. A comparison with a number that is not finite rules out nothing."""
    kept = smallest(groups(x + 0.0)[1], k + 1)
    z, codes, norms, gaps = model.scaled(x[kept]), codes[kept], norms[kept], gaps[kept]
    out = []
    for at in range(0, len(q), 64):
        near = best[at : at + 64]
        asked = model.scaled(q[at : at + 64])
        size, square = (asked**2).sum(1)[:, None], (z**2).sum(1)
        reach = np.array([min(far, np.sqrt(((x[rows[-1]] - own_q) ** 2).sum()) if len(rows) == k else np.inf) for far, rows, own_q in zip(limit[at : at + 64], near, q[at : at + 64], strict=True)])[:, None] / model.scale * (1 + FINE)
        m, words, d = model.books.shape
        terms = np.abs(2 * asked @ model.books.reshape(m * words, d).T).reshape(len(asked), m, words).max(2).sum(1)[:, None]
        with np.errstate(all="ignore"):
            rough = lookups(asked, model.books, codes, norms) + size - ROUGH * (norms + terms)
            can = ~(np.sqrt(np.maximum(rough, 0)) - gaps - FINE * np.sqrt(size) > reach)
            rows = np.flatnonzero(can.any(0))
            can = can[:, rows] & ~(square[rows] + size - 2 * asked @ z[rows].T > reach**2 + FINE * 1e-3 * (square[rows] + size))
        for i, may in enumerate(can):
            both = np.union1d(kept[rows[may]], near[i])
            out.append(both[nearest(q[at + i : at + i + 1], own[at + i : at + i + 1], ids[both], x[both], k)[0]])
    return out


def groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group of equal rows, and the group of each row."""
    rows = np.ascontiguousarray(rows)
    _, first, group = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, group


def smallest(group: np.ndarray, most: int) -> np.ndarray:
    """The first `most` rows of each group, in the order of rows."""
    order = np.argsort(group, kind="stable")
    begins = np.searchsorted(group[order], group[order])
    return np.sort(order[np.arange(len(order)) - begins < most])


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the vector in double precision, for rows that take part; equal rows once."""
    v = F.col(embedding).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0)).dropDuplicates(["vec_id", "v"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


@dataclass
class Model:
    """Codebooks (codebooks, words, dimension) and the centroids of the inverted lists, both for vectors less `shift`, divided by `scale`.

    Without these, scores in single precision lose what tells vectors apart that are far from zero, very large or very small."""

    books: np.ndarray
    centroids: np.ndarray
    shift: np.ndarray | float = 0.0
    scale: float = 1.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) / self.scale

    def order(self, x: np.ndarray) -> np.ndarray:
        """The lists of each row, nearest first."""
        return np.argsort((self.centroids**2).sum(1) - 2 * (self.scaled(x) @ self.centroids.T), axis=1, kind="stable")

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From each row to each centroid, scaled, from below."""
        z = self.scaled(x)
        return np.stack([np.sqrt(((z - c) ** 2).sum(1)) for c in self.centroids], axis=1) * (1 - FINE) - FINE * np.sqrt((z**2).sum(1))[:, None]


def _codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def train(rows: DataFrame, lists: int, most: int = SAMPLE) -> Model:
    """A model of a bounded sample of usable rows, made in one task; the driver gets the model alone."""

    def run(batches):
        parts = [(b.column("vec_id").to_numpy(), _matrix(b.column("v"))) for b in batches if b.num_rows]
        if parts:
            ids, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            x = x[np.argsort(ids, kind="stable")]
            shift = x.mean(0)
            most = np.abs(x - shift).max() or 1.0
            scale = float(most * np.sqrt((((x - shift) / most) ** 2).mean())) or 1.0
            x = Model(x, x, shift, scale).scaled(x)
            centroids = _k_means(x, max(1, min(lists, len(x) // 8)), np.random.default_rng(3))
            parts = [pa.array([a.tobytes()], pa.binary()) for a in (fit(x), centroids, shift)]
            yield pa.RecordBatch.from_arrays([*parts, pa.array([scale]), pa.array([x.shape[1]])], names=["books", "centroids", "shift", "scale", "d"])

    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).repartition(1).mapInArrow(run, "books binary, centroids binary, shift binary, scale double, d long").first()
    if not found:
        return Model(np.zeros((1, 1, 1)), np.zeros((1, 1)))
    books, centroids = np.frombuffer(found["books"]), np.frombuffer(found["centroids"])
    return Model(books.reshape(CODEBOOKS, -1, found["d"]), centroids.reshape(-1, found["d"]), np.frombuffer(found["shift"]), found["scale"])


def index(rows: DataFrame, model: Model) -> DataFrame:
    """Every usable row with its list, its codes, the squared norm of its approximation, and how far it is from that (gap) and from its list's centroid (away), from above."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = model.scaled(_matrix(part.column("v")))
                codes, where = beam_encode(x, model.books), _assign(x, model.centroids)
                near = decoded(codes, model.books)
                with np.errstate(over="ignore"):
                    norms = (near**2).sum(1).astype(np.float32)
                gap, away = (np.sqrt(((x - y) ** 2).sum(1)) * (1 + FINE) + FINE * np.sqrt((x**2).sum(1)) for y in (near, model.centroids[where]))
                columns = [part.column("vec_id"), part.column("v"), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(norms), pa.array(where.astype(np.int32)), pa.array(gap), pa.array(away)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "codes", "norm", "list", "gap", "away"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, codes binary, norm float, list int, gap double, away double")


def calibrated(indexed: DataFrame, model: Model, k: int, every: int = 1, asked: int = CALIBRATION, in_lists: float = IN_LISTS, in_share: float = IN_SHARE) -> tuple[int, float]:
    """How many lists, and what share of a list's best lookup scores, hold so many of the exact neighbours of `asked` queries.

    Two scans of the index: exact neighbours, then how many codes of a neighbour's list score no worse than it. No model was
    fitted on the queries asked for, if there are enough rows. The driver gets `asked` times k rows."""
    spark = indexed.sparkSession
    sample = indexed.where(F.col("vec_id") % every == 0).select("vec_id", "v").orderBy(F.xxhash64("vec_id").desc(), "vec_id").limit(asked).collect()
    if not sample:
        return 1, 1.0
    own, q = np.array([r["vec_id"] for r in sample], np.int64), np.array([r["v"] for r in sample])
    shared = spark.sparkContext.broadcast((own, q, model))

    def neighbours(batches):
        own, q, model = shared.value
        m = model.books.shape[0]
        kept = [(np.empty(0, np.int64), np.empty((0, q.shape[1])), np.empty(0, np.int32), np.empty((0, m), np.uint8), np.empty(0, np.float32))] * len(own)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fresh = (part.column("vec_id").to_numpy(), _matrix(part.column("v")), part.column("list").to_numpy(), _codes(part.column("codes")), part.column("norm").to_numpy())
                for i, best in enumerate(nearest(q, own, fresh[0], fresh[1], k)):
                    both = [np.concatenate([old, new[best]]) for old, new in zip(kept[i], fresh, strict=True)]
                    best = nearest(q[i : i + 1], own[i : i + 1], both[0], both[1], k)[0]
                    kept[i] = tuple(c[best] for c in both)
        for i, (ids, x, where, codes, norms) in enumerate(kept):
            score = lookups(model.scaled(q[i : i + 1]), model.books, codes, norms)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i)), pa.array(ids), pa.array(((x - q[i]) ** 2).sum(1)), pa.array(where), pa.array(score)], names=["i", "vec_id", "distance", "list", "lookup"])

    near = indexed.mapInArrow(neighbours, "i long, vec_id long, distance double, list int, lookup float")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("distance", "vec_id"))).where(F.col("rank") <= k).select("i", "list", "lookup").collect()
    if not near:
        return 1, 1.0
    wanted = spark.sparkContext.broadcast([(r["i"], r["list"], r["lookup"]) for r in near])

    def better(batches):
        _, q, model = shared.value
        ahead, seen = np.zeros(len(wanted.value), np.int64), np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                codes, norms, where = _codes(part.column("codes")), part.column("norm").to_numpy(), part.column("list").to_numpy()
                first, _ = groups(np.concatenate([codes, where.astype("<i4").view(np.uint8).reshape(-1, 4)], axis=1))
                score, where = lookups(model.scaled(q), model.books, codes[first], norms[first]), where[first]
                rows = {j: np.flatnonzero(where == j) for j in np.unique(where)}
                for n, (i, j, limit) in enumerate(wanted.value):
                    if j in rows:
                        ahead[n] += np.count_nonzero(score[i, rows[j]] <= limit)
                        seen[n] += len(rows[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ahead))), pa.array(ahead), pa.array(seen)], names=["n", "ahead", "seen"])

    counted = indexed.mapInArrow(better, "n long, ahead long, seen long").groupBy("n").agg(F.sum("ahead").alias("ahead"), F.sum("seen").alias("seen")).collect()
    place = np.argsort(model.order(q), axis=1)
    depth, share = (np.sort(found)[max(0, int(np.ceil(held * len(near))) - 1)] for held, found in ((in_lists, [place[r["i"], r["list"]] + 1 for r in near]), (in_share, [r["ahead"] / r["seen"] for r in counted])))
    return int(depth), float(share)


def search(df: DataFrame, every: int = EVERY, k: int = NEIGHBOURS, share: float = SHARE, vec_id: str = "vec_id", embedding: str = "embedding", list_rows: int = LIST_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest that were found for each query."""
    spark = df.sparkSession
    rows = usable(df, vec_id, embedding)
    model = train(rows, max(1, min(LISTS, rows.count() // list_rows)))
    indexed = shared_table(spark, index(rows, model), "additive")
    if indexed.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    deep, measured = calibrated(indexed, model, k, every)
    share = max(share, measured)
    # LISTS rows at most.
    sizes, radii = np.zeros(len(model.centroids), np.int64), np.zeros(len(model.centroids))
    for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("away")).collect():
        sizes[r["list"]], radii[r["list"]] = r["rows"], r["away"]
    shared = spark.sparkContext.broadcast((model, sizes, radii))

    def enough(x, part):
        _, sizes, _ = shared.value
        order = shared.value[0].order(x)
        some = (np.cumsum(sizes[order], axis=1) - sizes[order] <= k) | (np.arange(order.shape[1]) < deep)
        return [o[e] for o, e in zip(order, some, strict=True)]

    def further(x, part):
        model, _, radii = shared.value
        can = ~(model.distances(x) - radii > part.column("reach").to_numpy()[:, None] / model.scale * (1 + FINE))
        return [np.setdiff1d(np.flatnonzero(c), seen).astype(np.int32) for c, seen in zip(can, part.column("lists").to_pylist(), strict=True)]

    def looking(asked: DataFrame, lists) -> DataFrame:
        """The queries with the lists to look into and how near a row must be."""

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("query_id", "key", "v", "reach")), pa.array(lists(_matrix(part.column("v")), part), pa.list_(pa.int32()))], names=["query_id", "key", "v", "reach", "lists"])

        return shared_table(spark, asked.mapInArrow(run, "query_id long, key long, v array<double>, reach double, lists array<int>"), "asked")

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("query_id", "key", "vec_id", "score")
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        model = shared.value[0]
        left = left.sort_by("vec_id")
        ids, x, norms, gaps = left["vec_id"].to_numpy(), _matrix(left["v"]), left["norm"].to_numpy(), left["gap"].to_numpy()
        codes = _codes(left["codes"])
        who, key, q, reach = right["query_id"].to_numpy(), right["key"].to_numpy(), _matrix(right["v"]), right["reach"].to_numpy()
        best = reranked(q, who, ids, x, codes, norms, model.books, k, share, model.scaled(q))
        best = certified(q, who, ids, x, codes, norms, gaps, model, k, best, reach)
        spot, row = np.repeat(np.arange(len(best)), [len(b) for b in best]), np.concatenate(best)
        return pa.table(dict(zip(names, (who[spot], key[spot], ids[row], np.sqrt(((x[row] - q[spot]) ** 2).sum(1))), strict=True)))

    def looked(asked: DataFrame) -> DataFrame:
        """The nearest rows of each query in each part of its lists."""
        wanted = asked.select(F.explode("lists").alias("list")).groupBy("list").count()
        counts = {r["list"]: r["count"] for r in wanted.collect()}  # LISTS rows at most
        plan = [(i, int(-(-sizes[i] // BLOCK)), -(-counts[i] // QUERY_BLOCK)) for i in range(len(sizes)) if sizes[i] and i in counts]
        cells = F.broadcast(spark.createDataFrame(plan, "list int, parts int, chunks int"))
        # Rows are dealt by vector and id together, so neither a common vector nor a repeated id fills one part.
        ours = indexed.join(cells, "list").select("list", F.pmod(F.xxhash64("vec_id", "v"), "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "v", "codes", "norm", "gap")
        theirs = asked.select("query_id", "key", "v", "reach", F.explode("lists").alias("list")).join(cells, "list")
        theirs = theirs.select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.pmod("key", "chunks").cast("int").alias("chunk"), "query_id", "key", "v", "reach")
        found = ours.groupBy("list", "part", "chunk").cogroup(theirs.groupBy("list", "part", "chunk")).applyInArrow(run, "query_id long, key long, vec_id long, score double")
        return ranked(found)

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "key", "rank", "vec_id", "score")

    asked = indexed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("vec_id", "v").alias("key"))
    asked = looking(asked.withColumn("reach", F.lit(float("inf"))), enough)
    found = shared_table(spark, looked(asked), "looked")
    last = found.where(F.col("rank") == k).select("query_id", "key", F.col("score").alias("far"))
    rest = looking(asked.join(last, ["query_id", "key"], "left").withColumn("reach", F.coalesce("far", "reach")), further).where(F.size("lists") > 0)
    if not rest.isEmpty():
        found = ranked(found.drop("rank").unionByName(looked(rest).drop("rank")))
    return found.select("query_id", "rank", "vec_id", "score")


def op7_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector among all."""
    return search(read(spark, sf_dir, "embeddings"))
