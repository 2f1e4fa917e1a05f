"""Merkle manifest of a dataset: one tree a group, a tree over the groups' roots, and a proof for every row.

1. Leaf digests are made by SQL functions where the rows lie; from then on only digests move. They are ordered by (group,
   order) in one range exchange and cut into runs of up to RUN consecutive leaves of a group, kept as rows.
2. Counts of runs give each run the index of its first leaf. A run then pushes its leaves on a mountain-range stack: whenever
   the last node on the stack ends its parent (`fanout` children, or fewer at the end of a level), the children are replaced
   by it, like a carry in base `fanout`. What is left are the run's peaks: whole subtrees inside it, a few for each level.
   Nothing is padded; a short last parent is the digest of the children that it has, even of one.
3. Peaks of neighbouring runs are merged on the same stack, first in groups of about the square root of the number of runs,
   then group by group: edges that no run could finish get done there. Peaks and merged nodes are the node records.
4. A run's leaves need, from outside, only siblings of the first and the last of its nodes on each level; all of these are
   node records. They are joined to the run, which makes its own inner nodes again and gives every leaf its path.
The groups' roots are the leaves of one more such tree, however many groups there are.

No task holds more than a run, or the node records of the runs that it merges.

Defined results: digests are lower-case hex SHA-256 of joined inputs, digests among them as hex text; a null value counts as
`-`, any other as its UTF-8 bytes' number, a colon and the value, so an empty text differs from a null; texts of any length
are hashed whole; a null group or order value comes first; rows equal in group and order are ordered by leaf, and rows equal
in that too are leaves each of their own, with places among them that change no digest but their own proofs; an empty table
has no leaves and no root; extra columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SQL_CRC_TABLE, cut, read, shared_table, sql_crc

#: Leaves of a run, and rows of a dataset that are tampered with: those whose checksum this divides.
RUN, TAMPER = 1 << 14, 7
NODES = "grp string, level int, index long, digest string, total long, root boolean"

Node = tuple[int, int, str]  # level, index, digest


def joined(digests: list[str]) -> str:
    """The digest of digests."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """The digest of a row's values, each as its length and itself."""
    texts = [v.cast("string") for v in values]
    whole = F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))
    return F.sha2(whole.cast("binary"), 256)


def level_counts(leaves: int, fanout: int) -> list[int]:
    """How many nodes each level has, from the leaves to the root."""
    counts = [leaves]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // fanout))
    return counts


class Mountains:
    """A stack of whole subtrees; each push carries as far as it can, up to level `top`."""

    def __init__(self, counts: list[int], fanout: int, top: int | None = None) -> None:
        self.counts, self.fanout, self.top = counts, fanout, len(counts) - 1 if top is None else min(top, len(counts) - 1)
        self.stack: list[Node] = []

    def push(self, node: Node) -> Iterator[Node]:
        """The nodes that carries complete."""
        stack, fanout = self.stack, self.fanout
        stack.append(node)
        while True:
            level, index, _ = stack[-1]
            if level >= self.top or index % fanout != fanout - 1 and index != self.counts[level] - 1:
                return
            own = index % fanout + 1
            first = stack[-own] if len(stack) >= own else (-1, -1, "")
            if first[:2] != (level, index - own + 1):
                return  # the first children lie outside
            parent = (level + 1, index // fanout, joined([d for *_, d in stack[-own:]]))
            del stack[-own:]
            stack.append(parent)
            yield parent


class Forest(NamedTuple):
    """runs: (grp, task, place, n, base, total, leaves, and payload arrays); nodes: node records; roots: (grp, digest, total)."""

    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame
    fanout: int


def _runs(df: DataFrame, payload: list[str], size: int) -> DataFrame:
    """One row for each run of ordered rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, place, parts, held, group = TaskContext.get().partitionId(), 0, [], 0, None

        def closed() -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            lists = [pa.LargeListArray.from_arrays(pa.array([0, held], pa.int64()), table[c].chunk(0)).cast(pa.list_(table[c].type)) for c in ("leaf", *payload)]
            return pa.RecordBatch.from_arrays([pa.array([group]), pa.array([task], pa.int32()), pa.array([place], pa.int32()), pa.array([held], pa.int32()), *lists], names=["grp", "task", "place", "n", "leaf", *payload])

        for batch in batches:
            groups, at = batch.column("grp").to_pylist(), 0
            while at < len(groups):
                if parts and (groups[at] != group or held == size):
                    yield closed()
                    parts, held, place = [], 0, place + 1
                group, end = groups[at], at
                while end < len(groups) and end - at < size - held and groups[end] == group:
                    end += 1
                parts.append(batch.slice(at, end - at))
                held, at = held + end - at, end
        if parts:
            yield closed()

    kinds = dict(df.dtypes)
    return df.select("grp", "leaf", *payload).mapInArrow(run, "grp string, task int, place int, n int, leaf array<string>" + "".join(f", {c} array<{kinds[c]}>" for c in payload))


def _peaks(runs: DataFrame, fanout: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, base, total, leaves in zip(*(batch.column(c) for c in ("grp", "base", "total", "leaf")), strict=True):
                range_, first = Mountains(level_counts(total.as_py(), fanout), fanout), base.as_py()
                for i, leaf in enumerate(leaves.as_py()):
                    for _ in range_.push((0, first + i, leaf)):
                        pass
                yield _records(group.as_py(), range_.stack, total.as_py(), range_.counts)

    return runs.select("grp", "base", "total", "leaf").mapInArrow(run, NODES)


def _records(group: str, nodes: list[Node], total: int, counts: list[int]) -> pa.RecordBatch:
    n = len(nodes)
    levels, indexes, digests = ([x[k] for x in nodes] for k in range(3))
    columns = [pa.array([group] * n, pa.string()), pa.array(levels, pa.int32()), pa.array(indexes, pa.int64()), pa.array(digests, pa.string()), pa.array([total] * n, pa.int64()), pa.array([x == len(counts) - 1 for x in levels], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["grp", "level", "index", "digest", "total", "root"])


def _merged(nodes: DataFrame, fanout: int, top: int | None) -> DataFrame:
    """Nodes that neighbours make together: below each node of level `top`, or in the whole of each group."""
    if top is None:
        keys = ["grp"]
    else:
        powers = F.element_at(F.array(*(F.lit(fanout ** (top - k)) for k in range(top + 1))), F.col("level") + 1)
        nodes, keys = nodes.where(F.col("level") <= top).withColumn("below", F.floor(F.col("index") / powers).cast("long")), ["grp", "below"]

    def run(table: pa.Table) -> pa.Table:
        range_, made = Mountains(level_counts(table["total"][0].as_py(), fanout), fanout, top), []
        rows = zip(*(table[c].to_pylist() for c in ("level", "index", "digest")), strict=True)
        for node in sorted(rows, key=lambda n: n[1] * fanout ** n[0]):
            made += range_.push(node)
        return pa.Table.from_batches([_records(table["grp"][0].as_py(), made, table["total"][0].as_py(), range_.counts)])

    return nodes.groupBy(*keys).applyInArrow(run, NODES)


def forest(df: DataFrame, group: Column, order: list[Column], leaf: Column, payload: dict[str, Column] | None = None, fanout: int = 2, size: int = RUN) -> Forest:
    """The trees of all groups over their leaves in order."""
    spark, payload = df.sparkSession, payload or {}
    keys = [f"order_{k}" for k in range(len(order))]
    # A null group is the empty text here, any other text follows an equals sign: so it sorts as UTF-8 bytes, null first.
    grp = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    rows = df.select(grp.alias("grp"), *(c.alias(k) for k, c in zip(keys, order, strict=True)), leaf.alias("leaf"), F.monotonically_increasing_id().alias("row"), *(c.alias(n) for n, c in payload.items()))
    rows = shared_table(spark, rows, "leaves")
    by = ["grp", *keys, "leaf", "row"]
    runs = shared_table(spark, _runs(rows.repartitionByRange(*by).sortWithinPartitions(*by), list(payload), size), "runs")
    meta = runs.select("grp", "task", "place", "n")
    before = Window.partitionBy("grp").orderBy("task", "place").rowsBetween(Window.unboundedPreceding, -1)
    meta = meta.select("task", "place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    placed = runs.join(cut(meta), ["task", "place"])
    peaks = cut(_peaks(placed, fanout))
    # A subtree of level `top` covers about as many runs as there are such subtrees: leaves of a run, times the root of the number of runs.
    seen = runs.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("leaves")).first()
    top = math.ceil(math.log(max(1.0, seen["leaves"] / max(1, seen["runs"]) ** 0.5), fanout))
    inner = cut(_merged(peaks, fanout, top))
    high = peaks.where(F.col("level") >= top).unionByName(inner.where(F.col("level") == top))
    nodes = cut(peaks.unionByName(inner).unionByName(_merged(high, fanout, None)))
    return Forest(placed, nodes, nodes.where("root").select("grp", "digest", "total"), fanout)


class Paths:
    """Siblings of the leaves of one run, level by level, from its own leaves and the nodes outside."""

    def __init__(self, base: int, total: int, leaves: list[str], outside: dict[tuple[int, int], str], fanout: int) -> None:
        self.base, self.fanout, self.counts = base, fanout, level_counts(total, fanout)
        first, last = base, base + len(leaves) - 1
        level = {base + i: d for i, d in enumerate(leaves)}
        self.levels: list[dict[int, str]] = []
        for k, count in enumerate(self.counts):
            for low, high in _beside(first, last, count, fanout):
                level.update((j, outside[k, j]) for j in range(low, high))
            self.levels.append(level)
            first, last = first // fanout, last // fanout
            level = {p: joined([level[j] for j in range(p * fanout, min(count, (p + 1) * fanout))]) for p in range(first, last + 1)} if count > 1 else {}
        #: Siblings from a parent of leaves upwards, as (before, after).
        self.above: dict[int, list[tuple[str, str]]] = {}

    def _pair(self, k: int, j: int) -> tuple[str, str]:
        low = j - j % self.fanout
        return "".join(self.levels[k][x] for x in range(low, j)), "".join(self.levels[k][x] for x in range(j + 1, min(self.counts[k], low + self.fanout)))

    def path(self, i: int) -> list[tuple[str, str]]:
        """For leaf base + i, on each level below the root: the digests before it in its run of siblings, and those after it."""
        j = self.base + i
        if len(self.counts) == 1:
            return []
        parent = j // self.fanout
        if parent not in self.above:
            if len(self.above) > 64:
                self.above.clear()
            self.above[parent] = [self._pair(k, j // self.fanout**k) for k in range(1, len(self.counts) - 1)]
        return [self._pair(0, j), *self.above[parent]]


def _beside(first: int, last: int, count: int, fanout: int) -> list[tuple[int, int]]:
    """Indexes of the siblings before `first` and after `last` on a level."""
    if count == 1:
        return []
    return [(first - first % fanout, first), (last + 1, min(count, last - last % fanout + fanout))]


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its path lead to."""
    for before, after in path:
        leaf = joined([before, leaf, after])
    return leaf


def with_outside(made: Forest) -> DataFrame:
    """The runs of a forest with `outside`: (level, index, digest) of the nodes that their leaves' paths need."""
    fanout = made.fanout

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, last, out = row["base"], row["base"] + row["n"] - 1, []
                for k, count in enumerate(level_counts(row["total"], fanout)):
                    out += [(k, j) for low, high in _beside(first, last, count, fanout) for j in range(low, high)]
                    first, last = first // fanout, last // fanout
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([row["grp"]] * n, pa.string()), pa.array([row["task"]] * n, pa.int32()), pa.array([row["place"]] * n, pa.int32()), pa.array([k for k, _ in out], pa.int32()), pa.array([j for _, j in out], pa.int64())], names=["grp", "task", "place", "level", "index"])

    asked = made.runs.select("grp", "task", "place", "n", "base", "total").mapInArrow(needs, "grp string, task int, place int, level int, index long")
    found = asked.join(made.nodes.drop("total", "root"), ["grp", "level", "index"]).groupBy("task", "place").agg(F.collect_list(F.struct("level", "index", "digest")).alias("outside"))
    return made.runs.join(cut(found), ["task", "place"], "left")


def _paths_of(row: dict, fanout: int) -> Paths:
    return Paths(row["base"], row["total"], row["leaf"], {(n["level"], n["index"]): n["digest"] for n in row["outside"] or []}, fanout)


def group_paths(groups: Forest, fanout: int = 2) -> DataFrame:
    """(grp, root, path) for each group: the tree over the groups' roots in the order of their names, and the way up in it."""
    top = forest(groups.roots, F.lit(None), [F.col("grp")], F.col("digest"), {"name": F.col("grp")}, fanout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for batch in batches:
            for row in batch.to_pylist():
                paths = _paths_of(row, fanout)
                ways = [[{"before": a, "after": b} for a, b in paths.path(i)] for i in range(row["n"])]
                roots = [fold(leaf, paths.path(i)) for i, leaf in enumerate(row["leaf"])]
                yield pa.RecordBatch.from_arrays([pa.array(row["name"], pa.string()), pa.array(roots, pa.string()), pa.array(ways, kind)], names=["grp", "root", "path"])

    return with_outside(top).select("name", "leaf", "n", "base", "total", "outside").mapInArrow(run, "grp string, root string, path array<struct<before: string, after: string>>")


def manifest(df: DataFrame, group: Column, order: list[Column], values: list[Column], offered: Column, keys: dict[str, Column], fanout: int = 2) -> DataFrame:
    """keys, leaf, subroot, root, proof (all siblings joined, hashed), folded_root and verified for each row: whether `offered`, a
    leaf digest or null for the row's own, leads to the root by the row's path."""
    trees = forest(df, group, order, leaf_digest(*values), keys | {"offered_": offered}, fanout)
    tops = cut(group_paths(trees, fanout))
    named = {f.name: f.dataType.simpleString() for f in df.select(*(c.alias(n) for n, c in keys.items())).schema}
    names = list(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = {c: one.column(c)[0].as_py() for c in ("base", "total", "leaf", "outside", "path", "root", "digest", "offered_")}
                paths, top = _paths_of(row, fanout), [(n["before"], n["after"]) for n in row["path"]]
                beyond = "".join(a + b for a, b in top)
                proofs, folded = [], []
                for i, (leaf, other) in enumerate(zip(row["leaf"], row["offered_"], strict=True)):
                    way = paths.path(i)
                    proofs.append(hashlib.sha256(("".join(a + b for a, b in way) + beyond).encode()).hexdigest())
                    folded.append(fold(fold(other or leaf, way), top))
                n, root = len(proofs), row["root"]
                own = [one.column(c).flatten() for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(row["leaf"]), pa.array([row["digest"]] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])], names=[*names, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    heads = cut(trees.runs.select("grp", "task", "place").join(trees.roots.drop("total"), "grp").join(tops, "grp").drop("grp"))
    schema = "".join(f"{n} {kind}, " for n, kind in named.items()) + "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return with_outside(trees).join(heads, ["task", "place"]).drop("grp", "task", "place", "n").mapInArrow(run, schema)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by language; rows whose id's checksum 7 divides are offered with one character more."""
    docs = read(spark, sf_dir, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [(c.cast("decimal(20,0)") + 1).cast("string") if k == 3 else c for k, c in enumerate(values)]
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    return manifest(docs, F.col("lang"), [F.col("doc_id").cast("long")], values, F.when(struck, leaf_digest(*more)), {"doc_id": F.col("doc_id").cast("long")})


def _oracle() -> str:
    """Levels by recursion, for the languages and then for their roots; paths by joins of leaves with levels; folding by recursion over a path."""

    def tree(name: str, base: str) -> str:
        return f"""{name}(g, level, i, h, n) AS (SELECT * FROM {base} UNION ALL
  SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, i // 2, n)"""

    def value(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def leaf(n_chars: str) -> str:
        return f"sha256({' || '.join(value(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"

    def steps(tree: str, at: str, base: int) -> str:
        return f"""SELECT docs.row, {base} + a.level AS level, b.h AS sibling, b.i > a.i AS after FROM {at} JOIN {tree} a ON a.g = own AND a.n > 1 AND a.i = place // (1 << a.level) LEFT JOIN {tree} b ON b.g = a.g AND b.level = a.level AND b.i = xor(a.i, 1::BIGINT)"""

    return f"""
WITH RECURSIVE {SQL_CRC_TABLE}, d AS (SELECT *, {leaf('n_chars')} AS leaf, {leaf('(n_chars::HUGEINT + 1)')} AS other, coalesce('=' || lang, '') AS g FROM documents
), docs AS (SELECT d.*, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS row, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n,
  CASE WHEN {sql_crc('doc_id::VARCHAR')} % 7 = 0 THEN other ELSE leaf END AS offered FROM d, t
), leaves AS (SELECT g, 0 AS level, i, leaf AS h, n FROM docs
), {tree('nodes', 'leaves')}
, subs AS (SELECT g AS name, row_number() OVER (ORDER BY g) - 1 AS place, h, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (SELECT '' AS g, 0 AS level, place AS i, h, n FROM subs
), {tree('roots', 'tops')}
, ways AS ({steps('nodes', '(SELECT *, g AS own, i AS place FROM docs) docs', 0)}
  UNION ALL {steps('roots', "(SELECT docs.*, '' AS own, subs.place FROM docs JOIN subs ON subs.name = docs.g) docs", 1000)}
), steps AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY level) AS k FROM ways
), proofs AS (SELECT row, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY k)) AS proof_sha256, max(k) AS last FROM steps GROUP BY row
), folded(row, k, h) AS (SELECT row, 0::BIGINT, offered FROM docs
  UNION ALL SELECT s.row, s.k, sha256(CASE WHEN s.after THEN folded.h || s.sibling ELSE coalesce(s.sibling, '') || folded.h END) FROM folded JOIN steps s ON s.row = folded.row AND s.k = folded.k + 1)
SELECT docs.doc_id, docs.leaf, subs.h AS subroot, roots.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded.h AS folded_root, folded.h = roots.h AS verified
FROM docs JOIN subs ON subs.name = docs.g JOIN roots ON roots.n = 1 LEFT JOIN proofs ON proofs.row = docs.row JOIN folded ON folded.row = docs.row AND folded.k = coalesce(last, 0)
"""


ORACLE = _oracle()
