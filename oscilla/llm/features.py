"""Hashed features of whole texts: word and shape n-grams, word stems; all as numpy arrays over many texts."""

from __future__ import annotations

import numpy as np

from .words import BASE, LOWER, U, mix, owners, powers, running, span_hash, spans, words

#: Classes of bytes that a word's shape is made of: capitals, small letters, digits; other ASCII bytes stand for themselves, bytes of longer characters for nothing.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 0
_STEM = np.zeros(256, bool)
_STEM[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_REPEATED = U(0x5851F42D4C957F2D)


def lowered(raw: np.ndarray) -> np.ndarray:
    """Small letters for A-Z, and for the capitals of Latin-1 in UTF-8."""
    low = LOWER[raw]
    if len(raw) > 1:
        second = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
        low[1:][second] += 0x20
    return low


def shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's sequence of byte classes, with runs of one class counted once."""
    if not len(starts):
        return np.empty(0, U)
    kind = _CLASS[raw]
    lengths = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    word = np.repeat(np.arange(len(starts)), lengths)
    kind = kind[at]
    seen = kind != 0
    kind, word = kind[seen], word[seen]
    turn = np.ones(len(kind), bool)
    turn[1:] = (kind[1:] != kind[:-1]) | (word[1:] != word[:-1])
    kind, word = kind[turn].astype(U), word[turn]
    first = np.searchsorted(word, np.arange(len(starts) + 1))
    up, down = powers(len(kind) + 1)
    sums = np.zeros(len(kind) + 1, U)
    np.cumsum((kind + U(1)) * up[: len(kind)], dtype=U, out=sums[1:])
    return mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + (first[1:] - first[:-1]).astype(U))


def _joined(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbours within one text, and their texts."""
    if len(hashes) < n:
        return np.empty(0, U), np.empty(0, np.int64)
    same = owner[: len(owner) - n + 1] == owner[n - 1 :]
    total = np.zeros(len(hashes) - n + 1, U)
    for k in range(n):
        total = total * BASE + hashes[k : len(hashes) - n + 1 + k]
    return mix(total + U(n))[same], owner[: len(owner) - n + 1][same]


def style_grams(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of (hashes, texts): word 1- and 2-grams, and 1- to 3-grams of word shapes; a shape knows whether its word repeats the one before."""
    starts, ends, first = words(raw, offsets)
    owner = owners(first)
    low = span_hash(running(lowered(raw)), starts, ends)
    shape = shapes(raw, starts, ends)
    again = np.zeros(len(low), bool)
    again[1:] = (low[1:] == low[:-1]) & (owner[1:] == owner[:-1])
    shape = mix(shape ^ (again.astype(U) * _REPEATED))
    return [(low, owner), _joined(low, owner, 2), (shape ^ U(11), owner), _joined(shape ^ U(12), owner, 2), _joined(shape ^ U(13), owner, 3)]


def stem_grams(raw: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...] = (5, 6, 7)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of small-letter words without punctuation, and of their first bytes, and the text of each."""
    starts, ends = spans(_STEM[raw], offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    sums = running(lowered(raw))
    made, whose = [span_hash(sums, starts, ends)], [owner]
    for n in stems:
        longer = ends - starts > n
        made.append(span_hash(sums, starts[longer], starts[longer] + n) ^ U(n))
        whose.append(owner[longer])
    return np.concatenate(made), np.concatenate(whose)
