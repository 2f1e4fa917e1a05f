"""Near-duplicate documents by min-max hashing: banded signatures propose, full shingle sets decide.

Every permutation gives two values, the smallest and the largest, so 128 values cost 64 hash evaluations a shingle
(Ji et al., 2013). 32 bands of 4 values propose candidates. No bucket is ever expanded into all its pairs at once:

1. Texts with equal words are one node; only nodes have signatures.
2. In each bucket every member is held against the bucket's smallest one (a star), over whole shingle sets, and confirmed
   links give components.
3. Only in buckets that still hold several components are the pairs between different components looked at, in parts of
   bounded size whatever the bucket holds: first the pairs within each part, then, with the components that follow, those
   across parts. Signatures rule out pairs far below the limit and say whose texts are needed at all; whole sets decide the
   rest. The pairs never become rows; only links that join components do.

A link inside one component changes nothing, so no component is lost.

Most buckets have one member: only the members of the others are written down, and texts and signatures move only for nodes
that have such a bucket. A filter of FILTER_BITS bits leaves out most others before they move, a join the rest of them.

What can be missed: a pair at the similarity of 0.75 shares no band with a probability of (1 - 0.75^4)^32, about 5e-6, and
step 3 drops a pair whose signatures agree in less than 0.57 with one of about 3e-6 (less for likelier pairs; a component is
only split if no other link holds it). `exact` finds every pair instead: buckets are then the shingles of each set's prefix,
the n - ceil(0.75 n) + 1 of smallest hash, of which two sets at the limit must share one, and signatures rule out nothing.

Defined results: null texts and texts without words have no shingles, n_shingles 0, and are linked with nothing, not even
each other; a text of 1 to 4 words is one shingle; rows with one doc_id are one node, with whatever texts they carry; a row
without doc_id takes its group's component_id, null if nothing of the group has an id, and is kept; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, cut, read, shared_table, slices
from .words import LOWER, U, grams, mix, running, span_hash, words

WORDS = 5
SIMILARITY = 75
PERMUTATIONS = 64
BANDS = 32
ROWS = 2 * PERMUTATIONS // BANDS
#: Pairs whose signatures agree in less than this share are not confirmed: over 4.5 standard deviations below the limit.
ESTIMATE = 0.57
#: Members of a bucket, and shingles of theirs, that are held against as many others at once.
BLOCK = 512
PART_SHINGLES = 1_000_000
RUN_BYTES = 512 << 10
#: Bits that say which nodes may share a bucket, 8 MB whatever the input; one that is set by another node lets a row through to the join.
FILTER_BITS = 1 << 26
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, PERMUTATIONS), dtype=np.int64).astype(U)
_FACTORS, _TERMS = _SEEDS[0] | U(1), _SEEDS[1]


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """Of each text: its distinct shingles, sorted, as 64-bit hashes."""
    raw, offsets = buffer_of(texts)
    low = LOWER[raw]
    starts, ends, first = words(low, offsets)
    made, at = grams(span_hash(running(low), starts, ends), first, WORDS)
    sets = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = np.sort(made[a:b])
        sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return sets


def sequences(texts: pa.Array) -> list[bytes]:
    """Of each text: a digest of its words, joined by single spaces."""
    raw, offsets = buffer_of(texts)
    low = LOWER[raw]
    starts, ends, _ = words(low, offsets)
    step = np.zeros(len(low) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    chosen = np.cumsum(step, dtype=np.int8)[: len(low)] > 0
    low[~chosen] = 0x20
    chosen[ends[ends < len(low)]] = True
    packed, cuts = low[chosen].tobytes(), np.concatenate([[0], np.cumsum(chosen)])[offsets]
    return [hashlib.blake2b(packed[a:b].strip(b" "), digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Row i: smallest and largest value of set i under each permutation; sets must not be empty."""
    joined = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), U)
    for k in range(PERMUTATIONS):
        values = joined * _FACTORS[k] + _TERMS[k]
        values ^= values >> U(29)
        out[:, 2 * k] = np.minimum.reduceat(values, at)
        out[:, 2 * k + 1] = np.maximum.reduceat(values, at)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, with the band's number in it. A band takes its values from different permutations."""
    n = len(signature)
    # Smallest values first, then largest: a band of four has no two values of one permutation.
    spread = np.concatenate([signature[:, 0::2], signature[:, 1::2]], axis=1).reshape(n, BANDS, ROWS)
    key = np.zeros((n, BANDS), U)
    for k in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + spread[:, :, k])
    return mix(key + np.arange(BANDS, dtype=U))


def prefix(own: np.ndarray) -> np.ndarray:
    """The shingles of a sorted set of which any set at the limit shares one."""
    return own[: len(own) - -(-SIMILARITY * len(own) // 100) + 1]


def _signed(df: DataFrame, text: str, doc_id: str, exact: bool) -> DataFrame:
    """doc_id, key (words' digest), n_shingles, bands, brief (one byte of each signature value); a text without shingles has null bands."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, RUN_BYTES):
                sets, keys = shingles(part.column(text)), sequences(part.column(text))
                some = np.flatnonzero([len(s) > 0 for s in sets])
                band, brief = [None] * len(sets), [None] * len(sets)
                if len(some):
                    signature = signatures([sets[i] for i in some])
                    for i, b, s in zip(some, bands(signature).astype(np.int64), (mix(signature) & U(255)).astype(np.uint8), strict=True):
                        band[i], brief[i] = prefix(sets[i]).astype(np.int64) if exact else b, s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc_id).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(brief, pa.binary())],
                    names=["doc_id", "key", "n_shingles", "bands", "brief"],
                )

    return df.select(doc_id, text).mapInArrow(run, "doc_id long, key binary, n_shingles long, bands array<long>, brief binary")


def alike_sets(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * |x & y| >= 75 * |x | y| for sorted distinct shingles; an empty set is like nothing."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    if len(x) < len(y):
        x, y = y, x
    both = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
    return 100 * both >= SIMILARITY * (len(x) + len(y) - both)


def linked(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether 100 * |A & B| >= 75 * |A | B| for the whole shingle sets of each pair of texts."""
    left, right = shingles(a), shingles(b)
    return np.array([alike_sets(x, y) for x, y in zip(left, right, strict=True)], bool)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough. texts: (node, text), one row for each node."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a", RUN_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(linked(part.column("text_a"), part.column("text_b"))))

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; alternating large and small stars (Kiveris et al., 2014).

    Each round is two grouped minima and two joins on a narrow table, cut by a checkpoint; the number of rounds grows with
    the logarithm of the longest chain. Nothing but a sum goes to the driver."""
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = both.join(cut(low, before[0]) if large else low, "u")
        if large:
            return near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        return hung.where("u <> v").distinct()

    def state(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        edges = cut(star(star(edges, True), False), before[0])
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links: only the components that they join go through the rounds again."""
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = labels.unionAll(new.select("node", F.col("node").alias("component")))
    named = links
    for end in ("a", "b"):
        named = named.join(every.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end)
    tops = components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("top"))
    return cut(every.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component")))


def _shared_buckets(banded: DataFrame) -> DataFrame:
    """(node, place, band, head): the members of each bucket that has several, and the smallest of them."""
    members = banded.select("node", F.posexplode("bands").alias("place", "band"))
    heads = cut(members.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("top")).where("head < top").select("band", "head"))
    return members.join(heads, "band").select("node", "place", "band", "head")


def _among(nodes: DataFrame, bits: int = FILTER_BITS) -> Column:
    """Whether the column `node` may be one of nodes: true for all of them, and for few others while bits are many. The driver gets bits / 64 numbers at most."""
    place = F.pmod(F.xxhash64(F.coalesce("node", F.lit(0).cast("long"))), F.lit(bits))
    found = nodes.select(place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("b")).toPandas()
    words = np.zeros(-(-bits // 64), np.int64)
    words[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    shared = nodes.sparkSession.sparkContext.broadcast(words)

    def held(p: pd.Series) -> pd.Series:
        at = p.to_numpy(np.int64)
        return pd.Series(((shared.value[at >> 6] >> (at & 63)) & 1).astype(bool))

    return F.pandas_udf(held, "boolean")(place)


def _mixed(met: DataFrame, placed: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(band, parts): buckets (of those in `within`) that hold several components, and how many parts of BLOCK members and PART_SHINGLES shingles they need."""
    members = met.select("node", "band")
    if within is not None:
        members = members.join(within.select("band"), "band", "left_semi")
    members = members.join(placed.select("node", "component", "n_shingles"), "node")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / PART_SHINGLES)).cast("int")
    return members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), parts.alias("parts")).where("low < high").select("band", "parts")


def _near(table: pa.Table, exact: bool):
    """(row, other row, ...) of a group's pairs between different components that may be similar enough, best first; `label` may change between the steps."""
    node, label, size, part, place = (table[c].to_numpy().copy() for c in ("node", "component", "n_shingles", "part", "place"))
    alone = table["p"][0] == table["q"][0]
    brief = np.frombuffer(b"".join(table["brief"].to_pylist()), np.uint8).reshape(len(node), 2 * PERMUTATIONS)
    keys = None if exact else np.stack(table["bands"].to_pylist()).astype(np.int64)
    for i in range(len(node)):
        # Two parts meet here: pairs within a part belong to that part's own group.
        near = (label[i + 1 :] != label[i]) & (alone | (part[i + 1 :] != part[i])) & (100 * np.minimum(size[i + 1 :], size[i]) >= SIMILARITY * np.maximum(size[i + 1 :], size[i]))
        at = np.flatnonzero(near) + i + 1
        if not exact:
            # A pair is looked at in the first bucket that both share.
            at = at[(keys[at, : place[i]] != keys[i, : place[i]]).all(1)]
            alike = (brief[at] == brief[i]).sum(1)
            at = at[np.argsort(-alike, kind="stable")][: np.count_nonzero(alike >= ESTIMATE * 2 * PERMUTATIONS)]
        yield i, at, label


def _crossing(met: DataFrame, placed: DataFrame, mixed: DataFrame, texts: DataFrame, across: bool, exact: bool) -> DataFrame:
    """(a, b): confirmed links between components that share a bucket, as many as it takes to join them: within the parts of the buckets, or across them.

    Each part, or two parts, meet in a group of their own, so no task gets more than two parts of any bucket. Signatures
    come first, and only who has a partner by them comes again with the text."""
    own = met.select("node", "place", "band").join(mixed, "band").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    if across:
        own = own.where("parts > 1").select("*", F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part"))).alias("other"))
    else:
        own = own.withColumn("other", F.col("part"))
    met = own.select("node", "band", "place", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))

    def proposed(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        wanted = np.zeros(table.num_rows, bool)
        for i, at, _ in _near(table, exact):
            wanted[i] |= len(at) > 0
            wanted[at] = True
        return table.filter(pa.array(wanted)).select(["node", "band", "place", "part", "p", "q"])

    rest = placed.select("node", "component", "n_shingles", "brief", *([] if exact else ["bands"]))
    fields = "node long, band long, place int, part int, p int, q int"
    asked = met.join(rest, "node").groupBy("band", "p", "q").applyInArrow(proposed, fields)
    full = cut(asked).join(rest.join(texts, "node"), "node")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node = table["node"].to_numpy()
        sets: list[np.ndarray] = []
        for at in range(0, len(node), 64):
            sets += shingles(table["text"].slice(at, 64).combine_chunks())
        found = []
        for i, at, label in _near(table, exact):
            for j in at.tolist():
                if label[j] != label[i] and alike_sets(sets[i], sets[j]):
                    label[label == label[j]] = label[i]
                    found.append((node[i], node[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return full.groupBy("band", "p", "q").applyInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row for each row of df. `exact` leaves no pair to chance, with many more buckets."""
    spark = df.sparkSession
    signed = shared_table(spark, _signed(df, text, doc_id, exact), "minhash")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    # Each table of minima is cut off before it is joined back: a join of two plain exchanges can split a hot key.
    groups = cut(named.groupBy("key").agg(F.min("doc_id").alias("node")))
    members = shared_table(spark, signed.where("n_shingles > 0").select("doc_id", "key", "n_shingles").join(groups, "key", "left"), "members")
    nodes = members.where("doc_id = node").select("node", "key").distinct()
    banded = named.withColumnRenamed("doc_id", "node").join(nodes, ["node", "key"], "left_semi").dropDuplicates(["node", "key"])
    banded = shared_table(spark, banded.select("node", "n_shingles", "bands", "brief"), "banded")

    met = shared_table(spark, _shared_buckets(banded), "met")
    stars = cut(met.where("node > head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
    # Whoever shares a bucket is in a star, so these are the nodes of all pairs that can ever come up.
    ends = cut(met.select("node").distinct())
    likely = _among(ends)
    banded = shared_table(spark, banded.where(likely).join(ends, "node", "left_semi"), "ends")
    texts = df.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text")).where(likely).join(ends, "node", "left_semi").dropDuplicates(["node", "text"])
    texts = shared_table(spark, texts, "texts")
    links = cut(confirmed(stars, texts))

    # A doc_id with several texts hangs together with the nodes of all of them.
    several = members.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    same = members.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = cut(links.unionAll(same))
    labels = components(links)
    mixed = None
    for across in (False, True):
        placed = banded.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "bands", "brief", "n_shingles")
        mixed = cut(_mixed(met, placed, mixed))
        crossing = cut(_crossing(met, placed, mixed, texts, across, exact))
        if not crossing.isEmpty():
            labels = joined(labels, crossing)
        mixed = cut(mixed.where("parts > 1"))
        if mixed.isEmpty():
            break

    found = members.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    rows = found.unionAll(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component."""
    return near_duplicates(read(spark, sf_dir, "documents"))


#: The same in DuckDB: shingle sets, a join on shingles, components by recursion.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
