"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word's hash is a polynomial over its bytes modulo 2**64, cut out of one running sum, then mixed. All functions take
the joined bytes of several texts and the texts' offsets; no word ever spans two texts."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
#: An odd base and its inverse modulo 2**64.
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@functools.lru_cache(maxsize=1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, U), np.full(size, INVERSE, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least of each."""
    size = 1 << max(20, int(n).bit_length())
    return _tables(size)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads the low bits over all."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def running(raw: np.ndarray) -> np.ndarray:
    """sums[i] covers raw[:i]; a span's hash follows from two of them."""
    up, _ = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    values = raw.astype(U)
    values += U(1)
    values *= up[: len(raw)]
    np.cumsum(values, dtype=U, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True bytes within each text."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: starts, ends, and first[i]..first[i+1] are the words of text i."""
    starts, ends = spans(~SPACE[raw], offsets)
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a text, and where each text's begin; a text of 1 to n - 1 words has its whole sequence as one."""
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    if not at[-1]:
        return np.empty(0, U), at
    where = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], made)
    total = np.zeros(at[-1], U)
    left = np.repeat(first[1:], made) - where
    padded = np.concatenate([hashes, np.zeros(n, U)])
    for k in range(n):
        total = total * BASE + np.where(left > k, padded[where + k], U(0))
    return mix(total + np.repeat(np.minimum(counts, n), made).astype(U)), at
