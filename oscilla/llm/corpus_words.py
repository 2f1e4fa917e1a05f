"""Encodes every distinct word of a whole corpus once, and puts texts together again from words.

Texts are cut into words with their positions. Rows of up to BLOCK_BYTES of text form a block; within it a word that comes
again is kept as a number into the block's list of distinct words. One pass over the texts makes both, and one exchange deals
them: the lists by word over buckets, in proportion to the corpus, and the numbers by block. In a bucket, which has all blocks'
words of one hash, each distinct word is encoded once for the whole corpus; the ids go back, by a second exchange, to every
block that asked for the word, where the numbers put them together by position. The numbers are read from the first exchange
again. What moves are lists and numbers, packed; the texts never do. A hot word costs one entry a block, however often it
stands in texts. A block and a bucket share a packet, so there are never more of these than entries.

Decoding joins the ids of each distinct word of a block with the token-byte table, which a vocabulary bounds and each worker
holds, and puts the bytes together by position. An id that the table lacks is an error.

No step depends on the size of the input, but for the number of buckets. Memory in a task: one block (or one text where that
is longer), or one bucket. A block is named by its rows, so that a task that runs again after a loss makes the same blocks of
the same rows; rows that are not a plain scan of files are written once first."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, large_binary, plan_bytes, shared_table, slices
from .pretokens import Index, distinct, spread

BLOCK_BYTES = 8 << 20
#: Bytes of input for each bucket of words, and for each partition of an exchange, about; and buckets at least.
BUCKET_BYTES, PART_BYTES, BUCKETS = 8 << 20, 8 << 20, 32

#: Cuts texts (a large Arrow array) into words: joined bytes, starts, ends, and first[i]..first[i+1] are the words of text i.
Split = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
#: Made in a task: gives the ids of one word.
Encoder = Callable[[], Callable[[bytes], list[int]]]


class Laid:
    """The rows of one block, with their ids and the bytes that these decode to: ids[cut[i]:cut[i+1]] and data[place[i]:place[i+1]] are those of row i."""

    def __init__(self, doc_id: pa.Array, ids: np.ndarray, cut: np.ndarray, data: np.ndarray, place: np.ndarray) -> None:
        self.doc_id, self.ids, self.cut, self.data, self.place = doc_id, ids, cut, data, place

    def __iter__(self) -> Iterator[tuple[np.ndarray, bytes]]:
        for a, b, x, y in zip(self.cut[:-1].tolist(), self.cut[1:].tolist(), self.place[:-1].tolist(), self.place[1:].tolist(), strict=True):
            yield self.ids[a:b], self.data[x:y].tobytes()


def _pack_words(words: list[bytes]) -> bytes:
    import zstandard

    lengths = np.array([len(w) for w in words], "<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(words)], "<u4").tobytes() + lengths.tobytes() + b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, transposed into planes of bytes (of which the high ones are mostly zero) and compressed."""
    import zstandard

    planes = b"".join(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(a) for a in arrays], "<u4").tobytes() + planes)


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 4 * n
    for length in np.frombuffer(raw, "<u4", n).tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * length, at).reshape(4, length)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1))
        at += 4 * length
    return out


class _Block:
    """Texts in reading order, their words as numbers, and the distinct words by number."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.numbers: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.index = Index()
        self.words: list[bytes] = []
        self.size = 0
        self.digest = hashlib.blake2b(digest_size=16)

    def add(self, doc_id: pa.Array, texts: pa.Array, split: Split) -> None:
        raw, starts, ends, first = split(texts)
        data, found = raw.tobytes(), distinct(raw, starts, ends)
        numbers = None
        if found is not None:
            keys, index, where = found
            words = [data[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]
            place = self.index.find(keys)
            if all(p < 0 or self.words[p] == w for p, w in zip(place.tolist(), words, strict=True)):
                new = np.flatnonzero(place < 0)
                place[new] = len(self.words) + np.arange(len(new))
                self.words += [words[i] for i in new.tolist()]
                self.index.add(keys[new], place[new])
                numbers = place[where]
        if numbers is None:
            # Two different words have one hash: these texts are numbered by the bytes themselves.
            known, numbers = {w: i for i, w in enumerate(self.words)}, np.empty(len(starts), np.int64)
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                numbers[k] = known.setdefault(data[a:b], len(known))
            self.words = list(known)
        self.ids.append(doc_id)
        self.numbers.append(numbers)
        self.counts.append(np.diff(first))
        kept, at = buffer_of(texts)
        self.size += len(kept)
        for part in (kept.tobytes(), at.tobytes(), str(doc_id.to_pylist()).encode()):
            self.digest.update(part)

    def rows(self, buckets: int, salt: bytes) -> Iterator[dict]:
        """One row with the numbers, and one for each bucket with its words; words are numbered anew, bucket by bucket, most frequent first."""
        name = self.digest.digest() + salt
        numbers, counts = np.concatenate(self.numbers), np.concatenate(self.counts)
        bucket = np.fromiter(map(zlib.crc32, self.words), np.int64, len(self.words)) % buckets
        order = np.lexsort((-np.bincount(numbers, minlength=len(self.words)), bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        yield {"route": name, "block": name, "bucket": None, "doc_ids": pa.concat_arrays(self.ids).to_pylist(), "packed": _pack(rank[numbers], counts)}
        sorted_ = bucket[order]
        edges = np.flatnonzero(np.diff(sorted_, prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = int(sorted_[a])
            yield {"route": own.to_bytes(8, "big"), "block": name, "bucket": own, "doc_ids": None, "packed": _pack_words([self.words[i] for i in order[a:b].tolist()])}


_ROWS = pa.schema([("route", pa.binary()), ("block", pa.binary()), ("bucket", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("packed", pa.binary())])


def blocks(df: DataFrame, split: Split, buckets: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(route, block, bucket, doc_ids, packed): for each block a row of numbers, without bucket, and its packets of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Equal blocks of one task are told apart by a number, those of different tasks by the tasks'.
        block, seen, task = _Block(), {}, TaskContext.get().partitionId().to_bytes(4, "big")

        def closed() -> Iterator[pa.RecordBatch]:
            key = block.digest.digest()
            seen[key] = seen.get(key, 0) + 1
            for row in block.rows(buckets, seen[key].to_bytes(4, "big") + task):
                yield pa.RecordBatch.from_pylist([row], _ROWS)

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                # A block ends with the row that fills it, wherever batches end.
                ends, first = block.size + buffer_of(part.column("text"))[1][1:], 0
                while first < part.num_rows:
                    last = min(part.num_rows, first + 1 + int(np.searchsorted(ends[first:], BLOCK_BYTES)))
                    rows = part.slice(first, last - first)
                    block.add(rows.column("doc_id"), large_binary(rows.column("text")), split)
                    if block.size >= BLOCK_BYTES:
                        yield from closed()
                        ends, block = ends - ends[last - 1], _Block()
                    first = last
        if block.ids:
            yield from closed()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "route binary, block binary, bucket long, doc_ids array<long>, packed binary")


def encoded(dealt: DataFrame, encoder: Encoder) -> DataFrame:
    """(block, bucket, ids): the ids of each word of each packet, from one encoding of each distinct word of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        encode, known, out = encoder(), {}, []
        table = table.filter(table["bucket"].is_valid())
        for data in table["packed"]:
            made = []
            for word in _unpack_words(data.as_py()):
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = encode(word)
                made.append(ids)
            counts = np.fromiter(map(len, made), np.uint32, len(made))
            out.append(_pack(np.fromiter((x for ids in made for x in ids), np.uint32, int(counts.sum())), counts))
        return pa.table({"block": table["block"], "bucket": table["bucket"], "ids": pa.array(out, pa.binary())})

    return dealt.groupBy("route").applyInArrow(run, "block binary, bucket long, ids binary")


class Tokens:
    """The token-byte table."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        size = max(tokens, default=-1) + 1
        lengths = np.full(size + 1, -1, np.int64)
        for i, data in tokens.items():
            lengths[i] = len(data)
        self.lengths, self.at = lengths, np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        self.data = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids joined with the table, and how many each group of counts[i] ids has."""
        ids = np.minimum(ids.astype(np.int64), len(self.lengths) - 1)
        lengths = self.lengths[ids]
        if (lengths < 0).any():
            raise ValueError("an id stands for no token")
        whole = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        return self.data[spread(self.at[ids], lengths)], whole[ends] - whole[ends - counts]


def encode(df: DataFrame, split: Split, encoder: Encoder, tokens: Callable[[], dict[int, bytes]], made: Callable[[Laid], pa.Table], schema: str, doc_id: str = "doc_id", text: str = "text", settled: bool = False) -> DataFrame:
    """`made` turns the rows of a block, encoded and decoded, into rows of `schema`. `settled`: df is a plain scan of files."""
    spark = df.sparkSession
    rows = df if settled else shared_table(spark, df.select(doc_id, text), "texts")
    size = plan_bytes(df)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    # Read twice: by the encoding of words, and where texts are put together.
    dealt = blocks(rows, split, max(BUCKETS, size // BUCKET_BYTES), doc_id, text).repartition(parts, "route")
    words = encoded(dealt, encoder).repartition(parts, "block")
    held: list[Tokens] = []  # one table a worker

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not held:
            held.append(Tokens(tokens()))
        return made(_laid(left.filter(left["bucket"].is_null()), right, held[0]))

    return dealt.groupBy("route").cogroup(words.groupBy("block")).applyInArrow(run, schema)


def _laid(heads: pa.Table, words: pa.Table, tokens: Tokens) -> Laid:
    """The texts of a block: its row of numbers, and the ids of its words in order of bucket and place. Without the row, as for the route of a bucket, there are none."""
    if not len(heads):
        if len(words):
            raise RuntimeError("a block's words came without its texts")
        return Laid(pa.array([], pa.int64()), np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.uint8), np.zeros(1, np.int64))
    rank, counts = _unpack(heads["packed"][0].as_py(), 2)
    lists = [_unpack(x.as_py(), 2) for x in words.sort_by("bucket")["ids"]]
    ids = np.concatenate([np.empty(0, np.uint32), *(x[0] for x in lists)])
    lengths = np.concatenate([np.empty(0, np.int64), *(x[1].astype(np.int64) for x in lists)])
    if len(heads) != 1 or (int(rank.max()) + 1 if len(rank) else 0) != len(lengths):
        raise RuntimeError("words of a block are missing")
    first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def placed(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = sizes[rank]
        return values[spread((np.cumsum(sizes) - sizes)[rank], own)], np.concatenate([[0], np.cumsum(own)])[first]

    return Laid(pa.array(heads["doc_ids"][0].as_py(), pa.int64()), *placed(ids, lengths), *placed(*tokens.decoded(ids, lengths)))
