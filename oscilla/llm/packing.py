"""Best-fit packing of tokenised documents, after Martello and Toth's dominance reduction.

What a packing needs to know of the corpus is how many pieces there are of each length: `capacity` numbers, however many
documents. The reduction and best-fit decreasing run on these counts, many equal bins at a time, and give layouts, each with
the number of bins that are filled by it. Then every piece finds its own place by its rank among the pieces of its length:
ranks are dealt to layouts in order. So the result is that of packing the whole corpus as one instance, while pieces are
ranked in parts of bounded size and never meet in one task or on the driver.

Defined results: a null text counts as empty, and an empty text is the end token alone; a text of any length is cut whole,
the remainder first; an added token of the
vocabulary (such as <|endoftext|>) in a text is its own id, wherever it stands, as in the library; pieces of one length take
their places by doc_id and piece; repeated rows are packed each on its own; a null doc_id is carried along; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import large_binary, read, shared_table, slices
from .pretokens import added_tokens, encode_texts, json_memory

CAPACITY = 1024
END = 2
#: Pieces of one length that are ranked together, about, and parts whose sizes are added up together.
PART, GROUP = 1 << 10, 1 << 12
RUN_BYTES = 512 << 10

#: How many bins, and for each the (length, number of pieces) in it.
Layouts = list[tuple[int, tuple[tuple[int, int], ...]]]


class _Counts:
    """How many items of each length are left."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts

    def largest(self, most: int) -> int:
        """The largest length up to `most`; 0 if there is none."""
        found = np.flatnonzero(self.n[: max(0, most) + 1])
        return int(found[-1]) if len(found) else 0

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """The lengths of the k smallest items longer than `above`, fewer if there are not so many."""
        out: list[int] = []
        for length in np.flatnonzero(self.n[above + 1 :])[:k] + above + 1:
            out += [int(length)] * min(k - len(out), int(self.n[length]))
        return out[:k]


def _times(n: np.ndarray, lengths: list[int]) -> int:
    """How often the lengths can be taken together."""
    return min(int(n[x]) // lengths.count(x) for x in set(lengths))


def _layout(lengths: list[int]) -> tuple[tuple[int, int], ...]:
    return tuple((x, lengths.count(x)) for x in sorted(set(lengths), reverse=True))


def reduce(counts: np.ndarray, capacity: int) -> tuple[Layouts, np.ndarray]:
    """Bins that some best packing has, and the counts of what is left.

    A set of items in one bin dominates another if its items can be matched with disjoint parts of the other's that are no
    longer. For the longest item j: alone, if nothing fits beside it; with the longest item that fits, if the two fill the
    bin, if no three fit, or if at most three fit and that item is as long as the best two together; and with the best two,
    if the longer of these is the longest that fits and no two items beyond the shorter one fit."""
    left, fixed = _Counts(counts.copy()), []
    n = left.n

    def fix(lengths: list[int]) -> None:
        times = _times(n, lengths)
        for x in lengths:
            n[x] -= times
        fixed.append((times, _layout(lengths)))

    for j in range(capacity, 0, -1):
        while n[j]:
            n[j] -= 1
            small, best = left.smallest(3), left.largest(capacity - j)
            pair = chosen = None
            if not best:
                chosen = [j]
            elif j + best == capacity or j + sum(small[:2]) > capacity or len(small) < 2:
                chosen = [j, best]
            elif len(small) < 3 or j + sum(small) > capacity:
                pair = _best_pair(left, capacity - j)
                a, b = pair
                if best >= a + b:
                    chosen = [j, best]
                elif best == a:
                    beyond = left.smallest(2, above=b)
                    if len(beyond) < 2 or j + sum(beyond) > capacity:
                        chosen = [j, a, b]
            n[j] += 1
            if chosen is None:
                break
            fix(chosen)
    return fixed, n


def _best_pair(left: _Counts, room: int) -> tuple[int, int]:
    """Two items of the largest sum up to `room`, the longer first."""
    n = left.n
    lengths = np.flatnonzero(n[: room + 1])
    best = (0, 0)
    for a in lengths[::-1]:
        if 2 * a < sum(best):
            break
        b = min(int(a), room - int(a))
        under = lengths[lengths <= b]
        if len(under) and under[-1] == a and n[a] < 2:
            under = under[:-1]
        if len(under) and a + under[-1] > sum(best):
            best = (int(a), int(under[-1]))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> Layouts:
    """Best-fit decreasing on counts: each item goes into the fullest bin that it fits into. Equal bins are filled together."""
    open_bins: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n, room = int(counts[length]), length
        while n:
            while room < capacity and not open_bins[room]:
                room += 1
            if room == capacity:
                # A new bin has room for `fit` of them, and takes them in turn, as it is then the fullest.
                layout, there = (), None
            else:
                layout, there = next(iter(open_bins[room].items()))
            fit = room // length
            full = n // fit if there is None else min(there, n // fit)
            for bins, items in ((full, fit), (1, n - full * fit)) if there is None or there > full else ((full, fit),):
                if bins and items and n:
                    took = (*layout, (length, items))
                    at = open_bins[room - items * length]
                    at[took] = at.get(took, 0) + bins
                    n -= bins * items
                    if there is not None:
                        there -= bins
            if there is not None:
                if there:
                    open_bins[room][layout] = there
                else:
                    del open_bins[room][layout]
    return [(bins, layout) for at in open_bins for layout, bins in at.items()]


def pack_counts(counts: np.ndarray, capacity: int) -> Layouts:
    fixed, left = reduce(counts, capacity)
    return fixed + best_fit(left, capacity)


def segments(layouts: Layouts) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a bin, first sequence, offset): which ranks of a length go to which bins."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for bins, layout in layouts:
        offset = 0
        for length, items in layout:
            first = rank.get(length, 0)
            rank[length] = first + bins * items
            out.append((length, first, first + bins * items, items, sequence, offset))
            offset += length * items
        sequence += bins
    return out


def pieces(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, turn (a number that spreads rows), and ids if wanted."""

    def run(batches):
        memory, added, turn = json_memory(tokenizer), added_tokens(tokenizer), 0
        for batch in batches:
            for part in slices(batch, text, RUN_BYTES):
                ids, cut = encode_texts(large_binary(part.column(text)), memory, added)
                row, piece, start, length, crc, raw = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], end).astype("<u4")
                    first = len(own) if len(own) <= capacity else len(own) % capacity or capacity
                    edges = [0, *range(first, len(own) + 1, capacity)]
                    for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        data = own[x:y].tobytes()
                        row.append(i), piece.append(k), start.append(x), length.append(y - x), crc.append(zlib.crc32(data))
                        if with_ids:
                            raw.append(data)
                columns = [part.column(doc_id).cast(pa.int64()).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(range(turn, turn + len(row)), pa.int64())]
                turn += len(row)
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if with_ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32", "turn"] + ["ids"] * with_ids)

    return df.select(doc_id, text).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, turn long" + ", ids binary" * with_ids)


def pack(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of all rows with sequence_id and offset. Each sequence holds at most `capacity` tokens, without gaps."""
    spark = df.sparkSession
    cut = shared_table(spark, pieces(df, tokenizer, text, doc_id, capacity, end, with_ids), "pieces")
    found = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # `capacity` rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for row in found:
        counts[row["length"]] = row["n"]
    places = spark.createDataFrame(segments(pack_counts(counts, capacity)), "length long, first long, after long, items long, sequence long, at long")

    # A length has as many parts as its pieces need; the list has `capacity` entries.
    parts = F.element_at(F.array(*(F.lit(max(1, int(-(-n // PART)))) for n in counts[1:])), F.col("length").cast("int"))
    spread = cut.withColumn("part", F.pmod(F.xxhash64("turn"), parts))
    sizes = spread.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # Pieces before each part, in two steps, so that no task orders all parts of a length: within a group of GROUP parts, and before the group.
    sizes = sizes.withColumn("group", F.floor(F.col("part") / GROUP))
    earlier = lambda *by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("length", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("length", "group", F.coalesce(F.sum("n").over(earlier("length", order="group")), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(earlier("length", "group", order="part")), F.lit(0))
    before = sizes.select("length", "group", "part", own.alias("own")).join(groups, ["length", "group"]).select("length", "part", (F.col("base") + F.col("own")).alias("before"))
    ranked = spread.withColumn("own", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "turn")))
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    # At most a few thousand layouts, whatever the corpus: the broadcast's size follows from `capacity`.
    placed = ranked.join(F.broadcast(places), "length").where("rank >= first and rank < after")
    k = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(k / F.col("items"))).cast("long").alias("sequence_id"), (F.col("at") + F.col("length") * (k % F.col("items"))).cast("long").alias("offset"), *(["ids"] if with_ids else [])
    )


def op8_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 1024 tokens."""
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
