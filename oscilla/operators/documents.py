"""Documents to sections to chunks, with provenance; page and status roll-ups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import characters as ch

MOST, OVERLAP = 1600, 200
#: Characters of texts that are looked at together.
RUN = 1 << 19
#: Where a chunk would rather end, from the best; the most characters and words of a title in capitals, and what it does not end in.
BREAKS = ("\n\n", "\n", ". ", "; ", " ")
TITLE_CHARACTERS, TITLE_WORDS, TITLE_NO_END = 120, 12, ".?!;"
_MARKED = re.compile(r"#{1,6}\s+(\S.*)")
CHUNK = "section_index int, section_title string, section_chunk_index int, ordinal int, character_start int, character_end int, content string"


class Texts:
    """Several texts, one behind the other, with sorted arrays of their places: where they may be cut, where they may be cut
    before something solid, where no white space can be cut off, and where each kind of break ends."""

    def __init__(self, texts: list[str]) -> None:
        self.text = "".join(texts)
        self.edges = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        self.points = ch.points(self.text)
        self.flags = ch.classes()[self.points]
        self.space, may = (self.flags & ch.SPACE) != 0, ch.cut_places(self.points, self.flags)
        self.begins = self.edges[:-1][self.edges[:-1] < len(self.text)]
        may[self.begins] = True
        self.cuts, self.solid, self.firm = (np.flatnonzero(x) for x in (may, may & ~self.space, ~(may & self.space)))
        self.breaks = []
        for mark in BREAKS:
            hit = self.points == ord(mark[-1])
            if len(mark) == 2:
                hit[1:] &= self.points[:-1] == ord(mark[0])
                hit[:1] = False
            self.breaks.append((np.flatnonzero(hit) + 1, len(mark)))

    @staticmethod
    def _from(places: np.ndarray, at: int, end: int) -> int:
        """The first of the places from `at` on, `end` if none comes before that."""
        k = np.searchsorted(places, at)
        return min(int(places[k]), end) if k < len(places) else end

    @staticmethod
    def _upto(places: np.ndarray, at: int) -> int:
        """The last of the places up to `at`, -1 if there is none."""
        k = np.searchsorted(places, at, side="right")
        return int(places[k - 1]) if k else -1

    def after_space(self, at: int, end: int) -> int:
        return self._from(self.solid, at + 1, end) if at < end and self.space[at] else at

    def bare(self, start: int, end: int) -> tuple[int, int]:
        """The span without white space at either end; never inside a character's marks."""
        start = self.after_space(start, end)
        return start, max(start, self._upto(self.firm, end - 1) + 1)

    def headings(self) -> list[tuple[int, str]]:
        """Where lines begin that are titles, and these: marked ones, and short lines of letters none of which is small, without a full stop."""
        starts = np.union1d(ch.line_starts(self.points, self.flags), self.begins).astype(np.int64)
        if not len(starts):
            return []
        count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
        letter = (self.flags & ch.LETTER) != 0
        capitals = (count(letter) > 0) & (count(letter & ((self.flags & ch.SMALL) != 0)) == 0)
        ends, found = np.append(starts[1:], len(self.text)), []
        for k in np.flatnonzero(capitals | (count(self.points == ord("#")) > 0)).tolist():
            line = self.text[starts[k] : ends[k]].strip()
            if title := _MARKED.fullmatch(line):
                found.append((int(starts[k]), title[1].strip()))
            elif capitals[k] and len(line) <= TITLE_CHARACTERS and len(line.split()) <= TITLE_WORDS and line[-1] not in TITLE_NO_END:
                found.append((int(starts[k]), line))
        return found

    def sections(self) -> Iterator[tuple[int, str | None, int, int]]:
        """(text, title, start, end) of the parts that titles begin, without the empty ones; a text without titles is one part, whole."""
        titles = dict(self.headings())
        marks = np.array(sorted(titles), np.int64)
        for i, (first, last) in enumerate(zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)):
            own = marks[np.searchsorted(marks, first) : np.searchsorted(marks, last)].tolist()
            if not own and first < last:
                yield i, None, first, last
            elif own:
                edges = [first, *(at for at in own if at > first), last]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    start, end = self.bare(a, b)
                    if start < end:
                        yield i, titles.get(a), start, end

    def end_of(self, at: int, limit: int) -> int:
        """Where a chunk from `at` ends if it must not go beyond `limit`: after the best break in its second half, else at the limit."""
        least = at + max((limit - at) // 2, 1)
        for ends, length in self.breaks:
            end = self._upto(ends, limit)
            if end - length >= least:
                return end
        return limit

    def spans(self, first: int, last: int, most: int, overlap: int) -> Iterator[tuple[int, int]]:
        """Overlapping spans of first..last with at most `most` characters each, unless one character with its marks is longer."""
        at = first
        while at < last:
            limit = min(at + most, last)
            end = limit
            if limit < last:
                end = self._upto(self.cuts, self.end_of(at, limit))
                if end <= at:
                    end = self._from(self.cuts, limit, last)
            start, bare = self.bare(at, end)
            if start < bare:
                yield start, bare
            if end == last:
                return
            at = self.after_space(self._from(self.cuts, max(at + 1, end - overlap), end), end)


def chunked(texts: list[str], most: int = MOST, overlap: int = OVERLAP) -> Iterator[tuple]:
    """(text, CHUNK fields) of the chunks of several texts, in order."""
    whole, at, index, ordinal = Texts(texts), -1, 0, 0
    for i, title, first, last in whole.sections():
        if i != at:
            at, index, ordinal = i, 0, 0
        index, base = index + 1, int(whole.edges[i])
        for k, (a, b) in enumerate(whole.spans(first, last, most, overlap), 1):
            ordinal += 1
            yield i, index, title, k, ordinal, a - base, b - base, whole.text[a:b]


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about RUN characters, and the number of each run's first; a longer text is a run of its own."""
    run, size, first = [], 0, 0
    for i, text in enumerate(texts):
        if run and size + len(text) > RUN:
            yield first, run
            run, size, first = [], 0, i
        run.append(text)
        size += len(text)
    if run:
        yield first, run


def chunks(df: DataFrame, key: str, text: str, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(key, CHUNK) of every text. Where a chunk begins depends on the one before, so Python; an Arrow batch for each run of texts."""
    fields = [f.split() for f in CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _runs([t or "" for t in batch.column(text).to_pylist()]):
                row, *columns = list(zip(*chunked(texts, most, overlap), strict=True)) or [()] * (len(fields) + 1)
                keys = batch.column(key).take(pa.array(np.array(row, np.int64) + first))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.string() if kind == "string" else pa.int32()) for c, (_, kind) in zip(columns, fields, strict=True))], names=[key, *(n for n, _ in fields)])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {CHUNK}")


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose texts have RUN bytes about; a longer text is a piece of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first, done = 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, done + RUN, "right")))
        yield batch.slice(first, last - first)
        first, done = last, int(ends[last - 1])


def _cleaned(batches: Iterator[pa.RecordBatch], key: str, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, text):
            made = [None if t is None else ch.cleaned(ch.points(t)) for t in part.column(text).to_pylist()]
            texts = [None if m is None else m[0].astype("<u4").tobytes().decode("utf-32-le") for m in made]
            spans = [pa.array([None if m is None else m[k].astype(np.int32) for m in made], pa.list_(pa.int32())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(texts, pa.string()), *spans], names=[key, "cleaned", "starts", "ends"])


def cleaned(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cleaned, starts, ends): each text without technical noise, and the span of the source that each of its characters stands for; null for a null text.

    A character takes some fifty bytes on its way, so an Arrow batch is worked off, and handed on, in runs of texts."""
    return df.select(key, text).mapInArrow(lambda b: _cleaned(b, key, text), f"{key} {df.schema[key].dataType.simpleString()}, cleaned string, starts array<int>, ends array<int>")


def _identities(key: str) -> tuple[Column, Column, Column]:
    """content_sha256, section_id and chunk_id, each from what it identifies."""
    number = lambda c: F.col(c).cast("string")
    content = F.sha2("content", 256)
    section = F.concat(F.lit("section_"), F.sha2(F.concat_ws(":", number(key), number("section_index"), F.coalesce("section_title", F.lit(""))), 256))
    chunk = F.concat(F.lit("chunk_"), F.sha2(F.concat_ws(":", number(key), section, number("ordinal"), number("character_start"), number("character_end"), content), 256))
    return content, section, chunk


def identified(df: DataFrame, key: str) -> DataFrame:
    """Adds content_sha256, section_id and chunk_id."""
    return df.select("*", *(c.alias(n) for c, n in zip(_identities(key), ("content_sha256", "section_id", "chunk_id"), strict=True)))


def sound(key: str) -> Column:
    """Whether a chunk's identities follow from its content, and its span from its length."""
    content, section, chunk = _identities(key)
    return (F.col("content_sha256") == content) & (F.col("section_id") == section) & (F.col("chunk_id") == chunk) & (F.col("character_end") - F.col("character_start") == F.length("content"))


def located(source: Column) -> Column:
    """Whether a chunk's content is what stands at its span of the source text."""
    return F.col("content") == F.substring(source, F.col("character_start") + 1, F.col("character_end") - F.col("character_start"))


def finite(vector: Column) -> Column:
    """Whether a vector has components, and each of them is a finite number."""
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def worst(status: Column, order: tuple[str, ...]) -> Column:
    """The value that comes first in `order` among a group's."""
    rank = F.array_position(F.array(*map(F.lit, order)), status)
    return F.min_by(status, rank)


def status(done: Column, failed: Column, review: Column) -> Column:
    """completed, attention, partial or failed, from what a document's pages or chunks came to."""
    return F.when(done == 0, "failed").when(failed > 0, "partial").when(review > 0, "attention").otherwise("completed")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and the new ones whose key is not stored; the same key with another content raises when the result is computed."""
    rest = [c for c in stored.columns if c not in keys]
    both = stored.select(*keys, F.struct(*rest).alias("old")).join(new.select(*keys, F.struct(*rest).alias("new")), keys, "full_outer")
    same = F.col("old").isNull() | F.col("new").isNull() | (F.col("old") == F.col("new"))
    kept = F.when(same, F.coalesce("old", "new")).otherwise(F.raise_error(F.lit("a stored record differs from a new one of the same key")).cast(both.schema["old"].dataType))
    return both.select(*keys, kept.alias("row")).select(*keys, "row.*")
