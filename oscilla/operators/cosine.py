"""The best documents of many questions by cosine of term weights, without a table of terms or of pairs.

Texts are dealt into blocks. A block sends each of its distinct terms once, in packets dealt over buckets, and gets back in how many
documents each occurs; so what moves is a block's vocabulary and not its postings. A block then weighs, measures and ranks its own documents
against all questions, of which a group has QUESTIONS at most, and hands on k rows a question. Terms are those of `retrieval.terms`."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import plain
from . import retrieval

#: Bytes of a block's texts about, most buckets, questions that are ranked together, and products that are summed at once.
BLOCK, BUCKETS, QUESTIONS, PRODUCTS = 1 << 22, 1 << 12, 1 << 10, 1 << 21
_PACKET = "bucket int, block int, terms binary, counts binary"


class Postings:
    """Terms of several texts. Words have codes in their order, 0 stands for none; a term is a word and the next one or none. Terms
    are ordered by bucket and then by words, whatever order the texts come in, and so are the postings (term, text, tf)."""

    def __init__(self, keys: pa.ChunkedArray, words: pa.ChunkedArray, buckets: int) -> None:
        words = pc.fill_null(words.combine_chunks(), []) if words.null_count else words.combine_chunks()
        found = keys.combine_chunks().dictionary_encode()
        order = pc.sort_indices(found.dictionary)
        self.keys = found.dictionary.take(order)
        text = _ranks(order)[found.indices.to_numpy(zero_copy_only=False)]
        coded = words.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.words = coded.dictionary.take(order)
        code = _ranks(order)[coded.indices.to_numpy(zero_copy_only=False)] + 1
        row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        self.base = len(self.words) + 1
        follows = np.flatnonzero(row[1:] == row[:-1])
        pair = np.concatenate([code * self.base, code[follows] * self.base + code[follows + 1]])
        text = np.concatenate([text[row], text[row[follows]]])
        # One sort by term and text counts both; a block is far from texts enough to go beyond 64 bits.
        texts = max(1, len(self.keys))
        if self.base**2 * texts >= 1 << 63:
            raise OverflowError("a block holds too many words and texts")
        both = np.sort(pair * texts + text)
        first = np.flatnonzero(np.diff(both, prepend=-1))
        tf, pair = np.diff(np.append(first, len(both))), both[first] // texts
        text = both[first] - pair * texts
        start = np.flatnonzero(np.diff(pair, prepend=-1))
        self.pairs = pair[start]
        hashes = np.array([1 << 33] + [zlib.crc32(w.encode()) for w in self.words.to_pylist()], np.uint64)
        mixed = hashes[self.pairs // self.base] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.pairs % self.base] * np.uint64(0xC2B2AE3D27D4EB4F)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16)
        #: The terms of `pairs` in the order of buckets, their places there, and their buckets.
        self.order = np.argsort(bucket, kind="stable")
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(self.order))
        self.bucket = bucket[self.order].astype(np.int64)
        many = np.diff(np.append(start, len(pair)))[self.order]
        sort = np.repeat(start[self.order] - (np.cumsum(many) - many), many) + np.arange(len(pair))
        self.term, self.text, self.tf = np.repeat(np.arange(len(many)), many), text[sort], tf[sort]

    def strings(self) -> pa.Array:
        """The terms in the order of buckets."""
        pairs = self.pairs[self.order]
        first, second = self.words.take(pa.array(pairs // self.base - 1)), pairs % self.base - 1
        both = pc.binary_join_element_wise(first, self.words.take(pa.array(second, mask=second < 0)), " ")
        return pc.coalesce(both, first)

    def packets(self, block: int, counts: bool) -> pa.Table:
        """A row for each bucket: its terms, and in how many texts each occurs, or none where texts don't count."""
        starts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        edges = np.append(starts, len(self.bucket))
        n = np.bincount(self.term, minlength=len(self.bucket)).astype("<i4") if counts else np.zeros(len(self.bucket), "<i4")
        terms = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), self.strings().cast(pa.binary())), b"\n").to_pylist()
        return pa.table({"bucket": pa.array(self.bucket[starts], pa.int32()), "block": pa.array(np.full(len(starts), block), pa.int32()), "terms": _packed(terms), "counts": _parted(n, edges)})

    def inverse(self, answers: pa.Table, documents: int) -> np.ndarray:
        """ln((1 + n) / (1 + df)) + 1 of the terms; 0 of one that no document has. answers: (bucket, counts) of every bucket that was sent to."""
        answers = answers.sort_by("bucket")
        df = np.frombuffer(b"".join(map(_unpacked, answers["counts"].to_pylist())), "<i8")
        return np.where(df > 0, np.log((1.0 + documents) / (1.0 + df)) + 1, 0.0)

    def placed(self, terms: pa.Array) -> np.ndarray:
        """Where terms stand among these, -1 for one that doesn't."""
        sides = pc.split_pattern(terms, " ")
        first = pc.index_in(pc.list_element(sides, 0), self.words)
        single = pc.equal(pc.list_value_length(sides), 1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(sides).to_numpy(zero_copy_only=False)) - 1
        second = pc.index_in(sides.flatten().take(pa.array(ends)), self.words)
        a, b = (pc.fill_null(x, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1 for x in (first, second))
        known, pair = (a > 0) & (single | (b > 0)), a * self.base + np.where(single, 0, b)
        at = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        known &= (self.pairs[at] == pair) if len(self.pairs) else False
        return np.where(known, self.place[at] if len(self.pairs) else 0, -1)


def _ranks(order: pa.Array) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order.to_numpy()] = np.arange(len(order))
    return out


def _packed(values: list[bytes]) -> pa.Array:
    """Each value's length and its bytes under zstd, which is half of what an exchange makes of them by itself."""
    return pa.array([len(v).to_bytes(8, "little") + pa.compress(v, "zstd", asbytes=True) for v in values], pa.binary())


def _unpacked(value: bytes) -> bytes:
    return pa.decompress(memoryview(value)[8:], int.from_bytes(value[:8], "little"), "zstd", asbytes=True)


def _parted(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return _packed([values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)])


def _counted(table: pa.Table) -> pa.Table:
    """A bucket's packets, with the number of documents of each term over all blocks in place of the block's own."""
    lists = pc.split_pattern(pa.array(map(_unpacked, table["terms"].to_pylist()), pa.large_binary()), b"\n")
    terms = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(terms, np.frombuffer(b"".join(map(_unpacked, table["counts"].to_pylist())), "<i4")).astype("<i8")[terms]
    edges = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    return pa.table({"block": table["block"], "bucket": table["bucket"], "counts": _parted(counts, edges)})


def _lengths(p: Postings, weight: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the texts."""
    return np.sqrt(np.bincount(p.text, weight * weight, len(p.keys)))


def _scores(p: Postings, raw: np.ndarray, place: np.ndarray, asked: np.ndarray, weight: np.ndarray, questions: int) -> np.ndarray:
    """Sums of products for each question and text, in the order of terms."""
    known = place >= 0
    order = np.argsort(place[known], kind="stable")
    place, asked, weight = (x[known][order] for x in (place, asked, weight))
    first, last = np.searchsorted(p.term, place, "left"), np.searchsorted(p.term, place, "right")
    upto, texts = np.cumsum(last - first), len(p.keys)
    out, a = np.zeros(questions * texts), 0
    while a < len(place):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PRODUCTS, "right")))
        many = (last - first)[a:b]
        posting = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[a:b], many)
        cell = np.repeat(asked[a:b], many) * texts + p.text[posting]
        out += np.bincount(cell, np.repeat(weight[a:b], many) * raw[posting], len(out))
        a = b
    return out.reshape(questions, texts)


def best(questions: DataFrame, docs: DataFrame, question: str, document: str, text: str, k: int) -> DataFrame:
    """(question, document, score, rank): the k best documents of each question that share a term with it, by cosine rounded to 9 places, ties to the smaller document."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    documents, blocks = size["n"], max(1, -(-(size["bytes"] or 0) // BLOCK))
    groups, buckets = max(1, -(-questions.count() // QUESTIONS)), min(BUCKETS, blocks)
    words = F.regexp_extract_all(plain(F.col(text)), F.lit(f"({retrieval.TOKEN})"), F.lit(1)).alias("words")

    def dealt(df: DataFrame, key: str, parts: int, tasks: int, sign: int) -> DataFrame:
        """(block, key, words); blocks of questions are numbered from -1 down. Texts move once, and are parted into words where they lie."""
        block = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        return df.select((block if sign > 0 else -1 - block).alias("block"), F.col(key).alias("key"), text).repartition(tasks, "block").select("block", "key", words)

    def sent(counts: bool):
        return lambda table: Postings(table["key"], table["words"], buckets).packets(table["block"][0].as_py(), counts)

    asked, told = dealt(questions, question, groups, groups, -1), dealt(docs, document, blocks, min(blocks, 1 << 14), 1)
    packets = told.groupBy("block").applyInArrow(sent(True), _PACKET).unionByName(asked.groupBy("block").applyInArrow(sent(False), _PACKET))
    answers = packets.groupBy("bucket").applyInArrow(_counted, "block int, bucket int, counts binary")
    # Every block weighs the questions by itself, from their words and what came back for them, so that all this is one query with one exchange of texts.
    every = F.explode(F.when(F.col("block") >= 0, F.array("block")).otherwise(F.sequence(F.lit(0), F.lit(blocks - 1)))).alias("to")
    source = F.col("block").alias("source")
    right = answers.select(every, source, "bucket", "counts").unionByName(asked.select(every, source, F.col("key").alias("asking"), F.col("words").alias("asked")), allowMissingColumns=True)

    rows = T.StructType([T.StructField(question, questions.schema[question].dataType), T.StructField(document, docs.schema[document].dataType), T.StructField("score", T.DoubleType())])
    made = to_arrow_schema(rows)

    def ranked(texts: pa.Table, found: pa.Table) -> pa.Table:
        out = [made.empty_table()]
        own, others = found.filter(pc.greater_equal(found["source"], 0)), found.filter(pc.less(found["source"], 0))
        if texts.num_rows and own.num_rows:
            p = Postings(texts["key"], texts["words"], buckets)
            raw = p.tf * p.inverse(own, documents)[p.term]
            length = _lengths(p, raw)
            for source in pc.unique(others["source"]).to_pylist():
                group = others.filter(pc.equal(others["source"], source))
                words, answers = (group.filter(x(group["bucket"])) for x in (pc.is_null, pc.is_valid))
                if answers.num_rows:
                    q = Postings(words["asking"], words["asked"], buckets)
                    out.append(_top(p, raw, length, q, q.tf * q.inverse(answers, documents)[q.term]))
        return pa.concat_tables(out)

    def _top(p: Postings, raw: np.ndarray, length: np.ndarray, asked: Postings, weight: np.ndarray) -> pa.Table:
        own = _lengths(asked, weight)
        unit = weight / np.where(own > 0, own, 1.0)[asked.text]
        dots = _scores(p, raw, p.placed(asked.strings())[asked.term], asked.text, unit, len(asked.keys))
        score = np.floor(dots / np.where(length > 0, length, 1.0) * 1e9 + 0.5) / 1e9
        score[dots <= 0] = -1.0
        picked = []
        for q, own in enumerate(score):
            least = np.partition(own, -k)[-k] if len(own) > k else -1.0
            near = np.flatnonzero((own >= least) & (own >= 0))
            near = near[np.argsort(-own[near], kind="stable")[:k]]
            picked.append((np.full(len(near), q), near, own[near]))
        q, d, s = (np.concatenate(x) for x in zip(*picked, strict=True))
        return pa.table([asked.keys.take(pa.array(q)), p.keys.take(pa.array(d)), pa.array(s)], schema=made)

    found = told.groupBy("block").cogroup(right.groupBy("to")).applyInArrow(ranked, rows)
    return retrieval.top(found, question, "score", [document], k)
