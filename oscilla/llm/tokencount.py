"""Token counts of a unigram vocabulary without building tokens: count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; for each place the best score up to it and
the number of pieces on that path are carried, nothing else. Ties follow the unigram tokenizer: a later candidate must be
strictly better, and candidates come by rising start, so among equal scores the longest last piece wins. A character that
no piece covers costs the lowest score less UNKNOWN_PENALTY and counts as many tokens as it has bytes (byte fallback).

Spaces are U+2581 and one is put before each text, as the vocabulary's own model says. No piece has that mark after another
character (a vocabulary with such a piece is refused), so the best path of a text is that of its stretches (spaces and what
follows them), and each distinct stretch is counted once in a worker's bounded memory. What the dynamic programme carries
covers the longest piece, so a stretch of any length takes no more memory than its own text. Scores of a piece vocabulary with merge ranks are whole numbers, so sums are exact.

Defined results: null and empty texts have 0 tokens; texts of any length are counted whole; repeated rows and null doc_ids
are kept; an empty table gives an empty table; extra columns pass through, and a column named like the count gives way.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import buffer_of, read, slices, without
from .pretokens import Memory
from .words import spans

#: Fixed value of unigram tokenizers.
UNKNOWN_PENALTY = 10.0
MARK = "▁"
RUN_BYTES = 512 << 10


def vocabulary(model_path: str) -> dict[str, float]:
    """The matchable pieces of a SentencePiece model and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    skip = (model.is_unknown, model.is_control, model.is_byte, model.is_unused)
    return cuttable({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in skip)})


def cuttable(pieces: dict[str, float]) -> dict[str, float]:
    """The pieces, if texts may be cut before spaces: ValueError for one that has the mark after another character."""
    for piece in pieces:
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"the piece {piece!r} crosses the beginning of a stretch")
    return pieces


def counter(pieces: dict[str, float]) -> Callable[[str], tuple[float, int]]:
    """A function that gives (best score, tokens) of a stretch of text, spaces already marked."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, score in pieces.items():
        automaton.add_word(piece, (len(piece), float(score)))
    if pieces:
        automaton.make_automaton()
    unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY

    room = max(map(len, pieces), default=0) + 1

    def count(text: str) -> tuple[float, int]:
        # Place p of the text is kept at p modulo `room`.
        best, tokens = [0.0] * room, [0] * room
        matches = automaton.iter(text) if pieces else iter(())
        pending = next(matches, None)
        for end, letter in enumerate(text):
            ended = []
            while pending is not None and pending[0] == end:
                ended.append(pending[1])
                pending = next(matches, None)
            top, here, single = None, 0, False
            # Longest first, which is by rising start.
            for length, score in sorted(ended, reverse=True) if len(ended) > 1 else ended:
                at = (end + 1 - length) % room
                score += best[at]
                single |= length == 1
                if top is None or score > top:
                    top, here = score, tokens[at] + 1
            if not single:
                at = end % room
                score = best[at] + unknown
                if top is None or score > top:
                    top, here = score, tokens[at] + len(letter.encode())
            at = (end + 1) % room
            best[at], tokens[at] = top, here
        at = len(text) % room
        return (best[at], tokens[at]) if text else (0.0, 0)

    return count


@functools.lru_cache(maxsize=4)
def memory_of(model_path: str) -> Memory:
    """The memory of this Python worker: the number of tokens of each distinct stretch."""
    count = counter(vocabulary(model_path))
    return Memory(lambda stretch: [count(stretch.decode().replace(" ", MARK))[1]])


def counts(texts: pa.Array, memory: Memory) -> np.ndarray:
    """Tokens of each text."""
    raw, offsets = buffer_of(texts)
    some = np.flatnonzero(np.diff(offsets))
    raw = np.insert(raw, offsets[some], 0x20)
    offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
    # A stretch begins where spaces (or marks of the text's own) begin; a text begins with one.
    blank = raw == 0x20
    own = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81))
    for k in range(3):
        blank[own + k] = True
    starts, _ = spans(blank, offsets)
    ends = np.append(starts[1:], len(raw)) if len(starts) else starts
    found, _ = memory(raw, starts, ends)
    total = np.concatenate([[0], np.cumsum(found, dtype=np.int64)])
    return np.diff(total[np.searchsorted(starts, offsets)])


def count_tokens(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, name: str = "n_tokens") -> DataFrame:
    """df's columns (or `keep`) and the number of tokens; no shuffle."""
    rest = without(df.select(*keep) if keep else df, name)
    columns = rest.columns

    def run(batches):
        memory = memory_of(model_path)
        for batch in batches:
            for part in slices(batch, text, RUN_BYTES):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(counts(part.column(text), memory))], names=[*columns, name])

    return df.select(*dict.fromkeys([*columns, text])).mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(name, T.LongType())]))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document, the piece vocabulary taken as a unigram one with its own scores."""
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
