"""Byte-level BPE over a whole corpus: every distinct pre-token is encoded once.

Texts are cut into pre-tokens with their positions, the distinct ones of the whole corpus are encoded once, and their ids
go back to where they are asked for and are laid out by position (see corpus_words.py). Decoding joins the ids of each
distinct pre-token with the token-byte table and puts the bytes together by position.

Defined results: a null text counts as empty and has no ids; a text of any length is encoded whole; a lone long run of
characters is one pre-token, as the pattern says; of equal merges in a pre-token the leftmost comes first, as in the library;
repeated rows and null doc_ids are kept, each row on its own; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import buffer_of, read
from .corpus_words import Laid, encode
from .pretokens import pretokens, rank_encoder, ranks


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pre-tokens of texts."""
    raw, offsets = buffer_of(texts)
    return raw, *pretokens(raw, offsets)


def token_bytes(ranks_path: str) -> dict[int, bytes]:
    """The bytes of each id."""
    return {i: token for token, i in ranks(ranks_path).items()}


def encode_documents(df: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the ids of each row, and the bytes that they decode to."""

    def made(rows: Laid) -> pa.Table:
        both = list(rows)
        return pa.table({"doc_id": rows.doc_id, "ids": pa.array([i for i, _ in both], pa.list_(pa.int32())), "decoded": pa.array([d for _, d in both], pa.binary())})

    return encode(df, split, functools.partial(rank_encoder, ranks_path), functools.partial(token_bytes, ranks_path), made, "doc_id long, ids array<int>, decoded binary", doc_id, text)


def op3_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def made(rows: Laid) -> pa.Table:
        out = [(len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(data).hexdigest()) for ids, data in rows]
        counts, ids, texts = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"doc_id": rows.doc_id, "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(texts, pa.string())})

    return encode(read(spark, sf_dir, "documents"), split, functools.partial(rank_encoder, path), functools.partial(token_bytes, path), made, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", settled=True)
