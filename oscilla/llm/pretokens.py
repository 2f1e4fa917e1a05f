"""Pre-tokens of many texts at once, and a memory of what a tokenizer makes of each distinct one.

The pattern is the one that byte-level BPE vocabularies of this family are split by:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Its matches depend only on the classes of neighbouring characters, so numpy finds all of them without a regex loop. A
pre-token's hash is that of words.py; those of over LONG bytes, where equal polynomial hashes could be built on purpose,
take a cryptographic one. Equal hashes are no proof: whatever is looked up by them is compared with the bytes it stands for."""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import buffer_of
from .words import U, running, span_hash

SPACE, LETTER, NUMBER, OTHER, EDGE = 0, 1, 2, 3, 4
LONG = 64
#: Bytes of a tokenizer's memory (ids of distinct pre-tokens) in one Python worker, beyond which it starts anew.
MEMORY_IDS = 4_000_000
#: Characters that \\s matches, as Unicode's White_Space property has them.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, from the same Unicode tables as `regex`, which the tests hold it against."""
    import regex

    everything = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    points = np.array([c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000])
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, everything):
            table[points[m.start() : m.end()]] = kind
    table[WHITE] = SPACE
    return table


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each starts (and, last, the end)."""
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = raw[at].astype(np.uint32)
    points = first.copy()
    if (first >= 0x80).any():
        more = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.uint32)
        for low, mask, extra in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            here = np.flatnonzero((first >= low) & (first < [0, 0xE0, 0xF0, 0x100][extra]))
            value = first[here] & mask
            for k in range(1, extra + 1):
                value = (value << 6) | (more[at[here] + k] & 0x3F)
            points[here] = value
    return points, np.append(at, len(raw))


def pretokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes of all matches, and first[i]..first[i+1] are those of text i. Matches cover each text without gaps."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    points, at = code_points(raw)
    n = len(points)
    kind = classes()[points]
    opens = np.zeros(n + 1, bool)  # a text begins here
    opens[np.searchsorted(at, offsets[offsets < len(raw)])] = True
    opens[n] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = EDGE, kind[:-1]
    before[opens[:n]] = EDGE
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = EDGE, kind[1:]
    after[opens[1:]] = EDGE

    start = kind != before
    space = kind == SPACE
    # The last white space before something else stands alone, or leads it if it is a blank.
    lone = space & (after != SPACE) & (after != EDGE)
    start |= lone
    led = np.zeros(n, bool)
    led[1:] = lone[:-1] & (points[:-1] == 0x20)
    start &= ~(led & ~opens[:n])

    # A lone apostrophe that begins a match takes the letters of a contraction; what is left of the letters begins a match of its own.
    quote = np.flatnonzero((points == 0x27) & start & (before != OTHER) & (after == LETTER))
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        same = np.concatenate([~opens[1:], np.zeros(3, bool)])[quote + 1]  # the next letter is in the same text
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        pair &= same & ~short
        for chosen, length in ((quote[short], 2), (quote[pair], 3)):
            start[chosen + 1] = False
            rest = chosen + length
            rest = rest[rest < n]
            start[rest] |= kind[rest] == LETTER
    starts = at[:-1][start]
    ends = np.append(starts[1:], len(raw))
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    made = span_hash(running(raw), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG):
        made[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return made


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Hashes of the distinct pre-tokens, the place of one of each, and which one each pre-token is; None if two different ones have one hash."""
    keys, index, where = np.unique(hashes(raw, starts, ends), return_index=True, return_inverse=True)
    lengths, first = ends - starts, index[where]
    if (lengths != lengths[first]).any() or (raw[spread(starts, lengths)] != raw[spread(starts[first], lengths)]).any():
        return None
    return keys, index, where


class Memory:
    """ids of each distinct pre-token, encoded once by `encode` and then looked up; bounded, and the same results at any bound."""

    def __init__(self, encode: Callable[[bytes], list[int]], most: int = MEMORY_IDS) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.index = Index()
        self.words: list[bytes] = []
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.at, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each pre-token has."""
        if self.used > self.most:
            self.clear()
        text, found = raw.tobytes(), distinct(raw, starts, ends)
        if found is None:
            return self._plainly(text, starts, ends)
        keys, index, where = found
        words = [text[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]
        place = self.index.find(keys)
        if any(p >= 0 and self.words[p] != w for p, w in zip(place.tolist(), words, strict=True)):
            return self._plainly(text, starts, ends)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            made = [self.encode(w) for w in fresh]
            counts = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.fromiter((x for ids in made for x in ids), np.int32, counts.sum())
            place[new] = len(self.words) + np.arange(len(new))
            self.words += fresh
            self.at = np.concatenate([self.at, self.used + np.cumsum(counts) - counts])
            self.lengths = np.concatenate([self.lengths, counts])
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.int32)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.index.add(keys[new], place[new])
        token = place[where]
        counts = self.lengths[token]
        return self.ids[spread(self.at[token], counts)], counts

    def _plainly(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without the memory, where two different pre-tokens have one hash."""
        made = [self.encode(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return np.array([x for ids in made for x in ids], np.int32), np.array([len(ids) for ids in made], np.int64)


class Index:
    """Places by 64-bit keys: a large sorted part and a small one that new keys go to, merged when it has grown to an eighth, so that adding stays cheap however many there are."""

    def __init__(self) -> None:
        self.parts = [(np.empty(0, U), np.empty(0, np.int64)) for _ in range(2)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that is not there."""
        found = np.full(len(keys), -1, np.int64)
        for own, places in self.parts:
            if len(own):
                spot = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                found = np.where(own[spot] == keys, places[spot], found)
        return found

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Adds sorted keys that are not there."""
        (large, where), (small, near) = self.parts
        spot = np.searchsorted(small, keys)
        small, near = np.insert(small, spot, keys), np.insert(near, spot, places)
        if 8 * len(small) > len(large):
            spot = np.searchsorted(large, small)
            large, where = np.insert(large, spot, small), np.insert(where, spot, near)
            small, near = small[:0], near[:0]
        self.parts = [(large, where), (small, near)]


def spread(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """at[i], at[i] + 1, ... counts[i] of them, for each i in turn."""
    total = np.cumsum(counts)
    if not len(total):
        return np.empty(0, np.int64)
    return np.arange(total[-1]) + np.repeat(at - total + counts, counts)


def encode_texts(texts: pa.Array, memory: Memory, added: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts in order, and cut[i]..cut[i+1] are those of text i. Texts are cut at `added` tokens first, each of which is its own id."""
    last = None
    if added and any(pc.any(pc.match_substring(texts, token)).as_py() for token in added):
        texts, last, tokens = _cut_at(texts, added)
    raw, offsets = buffer_of(texts)
    starts, ends, first = pretokens(raw, offsets)
    ids, counts = memory(raw, starts, ends)
    cut = np.concatenate([[0], np.cumsum(counts)])[first]
    if last is not None:
        follows = tokens >= 0
        ids = np.insert(ids, cut[1:][follows], tokens[follows])
        cut[1:] += np.cumsum(follows)
        cut = cut[last]
    return ids, cut


def _cut_at(texts: pa.Array, added: dict[str, int]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Stretches between added tokens, which of them end a text (with a 0 before), and the id of the token after each, -1 at a text's end. Of tokens that begin at one place the longest counts."""
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    stretches, tokens, last = [], [], [0]
    for text in texts.to_pylist():
        parts = pattern.split(text or "")
        stretches += parts[::2]
        tokens += [*(added[t] for t in parts[1::2]), -1]
        last.append(len(stretches))
    return pa.array(stretches, pa.large_string()), np.array(last), np.array(tokens)


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes, and its id, on each line."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@functools.lru_cache(maxsize=4)
def rank_encoder(path: str) -> Callable[[bytes], list[int]]:
    """Byte-pair merges of one pre-token by the ranks of a file."""
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return own._core_bpe.encode_single_piece


@functools.lru_cache(maxsize=4)
def memory_of(path: str) -> Memory:
    """The memory of this Python worker for a rank file."""
    return Memory(rank_encoder(path))


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary's JSON file, by its rule: printable Latin-1 stands for itself, the rest for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def json_encoder(path: str) -> Callable[[bytes], list[int]]:
    """Byte-pair merges of one pre-token by a tokenizer's JSON file, whose ids must rise in the order of its merges."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if model["type"] != "BPE" or any(x >= y for x, y in zip(made[:-1], made[1:], strict=True)):
        raise ValueError(f"{path}: ids do not rise with the merges")
    used = {a + b for a, b in pairs} | set(letters)
    vocabulary = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token in used}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})._core_bpe.encode_single_piece


@functools.lru_cache(maxsize=4)
def json_memory(path: str) -> Memory:
    """The memory of this Python worker for a JSON file."""
    return Memory(json_encoder(path))


@functools.lru_cache(maxsize=4)
def added_tokens(path: str) -> dict[str, int]:
    """The tokens of a tokenizer's JSON file that are matched in a text as they stand, before anything else; ValueError for those that would need more than that."""
    import json

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    for token in whole.get("added_tokens") or []:
        if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"] and whole.get("normalizer") or not token["content"]:
            raise ValueError(f"{path}: the added token {token['content']!r} is not matched literally")
    return {token["content"]: token["id"] for token in whole.get("added_tokens") or []}
