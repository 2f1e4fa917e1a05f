"""SentencePiece encoding and decoding over a whole corpus: every distinct marked word is segmented once.

A SentencePiece model of merges writes spaces as marks (U+2581), puts one mark before a text, and merges neighbouring pieces
by rank. If no piece of the vocabulary has a mark after another character, no merge joins a mark with what stands before it,
so the segmentation of a text is that of its marked words: a run of marks and the characters up to the next run. A model
that breaks this rule, that normalises characters, drops white space, adds no mark or has pieces defined by users is
refused. Words, their table and the way back to texts are those of corpus_words.py.

Decoding joins the ids of each distinct word with the table of pieces (marks are spaces, byte pieces are bytes, control
pieces are nothing), puts them together by position, and takes away the one space before the text.

Defined results: null and empty texts have the end id alone; a text of any length is encoded whole, a long run without
spaces being one word; U+2581 in a text counts as a space, as in the library, and comes back as one; repeated rows and null
ids of documents are kept, each row on its own; equal merge ranks do not occur in a model; an empty table gives an empty
table; extra columns are ignored."""

from __future__ import annotations

import functools
import hashlib
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import buffer_of, read
from .corpus_words import Laid, encode

MARK = "▁"


@functools.lru_cache(maxsize=4)
def model(path: str):
    """The model of a file; ValueError for one whose texts can't be cut into marked words."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    letters = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c) not in (" ", MARK))
    if found.normalize(letters) != MARK + letters or found.normalize("  a  b ") != f"{MARK * 3}a{MARK * 2}b{MARK}":
        raise ValueError(f"{path} changes characters or white space")
    for i in range(found.get_piece_size()):
        if MARK in found.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"the piece {found.id_to_piece(i)!r} crosses the beginning of a word")
    return found


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marked words of texts, with spaces for marks: each begins with a run of spaces, one of which stands before the text."""
    texts = pc.replace_substring(texts.cast(pa.large_string()), MARK, " ")
    lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    raw, offsets = buffer_of(pc.binary_join_element_wise(lead, texts, pa.scalar("", pa.large_string())))
    space = raw == 0x20
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(starts)
    return raw, starts, np.append(starts[1:], len(raw)), np.searchsorted(starts, offsets)


def encoder(path: str) -> Callable[[], Callable[[bytes], list[int]]]:
    """Made in a task: the ids of one marked word, whose first mark the library puts there itself."""

    def start() -> Callable[[bytes], list[int]]:
        own = model(path)
        alone = [own.piece_to_id(MARK)]  # the library gives an empty text no mark

        def ids(word: bytes) -> list[int]:
            return own.encode(word[1:].decode()) if len(word) > 1 else alone

        return ids

    return start


def piece_bytes(path: str) -> dict[int, bytes]:
    """What each id stands for in a decoded text."""
    own = model(path)

    def data(i: int) -> bytes:
        piece = own.id_to_piece(i)
        if own.is_control(i):
            return b""
        return bytes([int(piece[1:-1], 16)]) if own.is_byte(i) else piece.replace(MARK, " ").encode()

    return {i: data(i) for i in range(own.get_piece_size()) if not own.is_unknown(i)} | {own.unk_id(): own.decode([own.unk_id()]).encode()}


def encode_documents(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids with the end id, and the text that they decode to."""
    end = model(path).eos_id()

    def made(rows: Laid) -> pa.Table:
        both = [(np.append(ids, end), data[1:].decode()) for ids, data in rows]
        return pa.table({"doc_id": rows.doc_id, "ids": pa.array([i for i, _ in both], pa.list_(pa.int32())), "decoded": pa.array([t for _, t in both], pa.string())})

    return encode(df, split, encoder(path), functools.partial(piece_bytes, path), made, "doc_id long, ids array<int>, decoded string", doc_id, text)


def op12_piece_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with an end id, and decoded."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    end = model(path).eos_id()

    def made(rows: Laid) -> pa.Table:
        out = [(len(ids) + 1, hashlib.sha256(" ".join(map(str, [*ids.tolist(), end])).encode()).hexdigest(), hashlib.sha256(data[1:]).hexdigest()) for ids, data in rows]
        counts, ids, texts = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"doc_id": rows.doc_id, "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(texts, pa.string())})

    return encode(read(spark, sf_dir, "documents"), split, encoder(path), functools.partial(piece_bytes, path), made, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", settled=True)
