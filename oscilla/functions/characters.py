"""Texts as arrays of code points: where they may be cut, where white space stands, what noise cleanup leaves.

Classes are tables over all code points, so a question about a place in a text is a lookup, and a search for the next or
last place of some kind is a bisection of a sorted array."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

SPACE, LETTER, SMALL, EXTENDS, LINE = 1, 2, 4, 8, 16
#: The joiner, and skin tones, which extend the character before them as marks do.
JOINER, TONES = 0x200D, range(0x1F3FB, 0x1F400)
#: Noise that goes, and noise that breaks lines.
NOISE, BREAKING, MOST_LINE_ENDS = (0x00, 0x08, 0x7F), (0x0B, 0x0C), 3


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Flags of every code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            table[point] = LETTER | SMALL * c.islower()
        elif c.isspace():
            table[point] = SPACE | LINE * (len(f"x{c}x".splitlines()) > 1)
        elif c.islower():
            table[point] = SMALL
        elif unicodedata.category(c)[0] == "M":
            table[point] = EXTENDS
    table[list(TONES)] |= EXTENDS
    return table


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def cut_places(text: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Whether the text may be cut before each of its characters: not before a mark, nor on either side of a joiner."""
    joined = text == JOINER
    may = ~(((flags & EXTENDS) != 0) | joined)
    may[1:] &= ~joined[:-1]
    may[:1] = True
    return may


def line_starts(text: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Where lines begin, by any of the characters that end one; CR LF is one end."""
    ends = (flags & LINE) != 0
    ends[:-1] &= ~((text[:-1] == 0x0D) & (text[1:] == 0x0A))
    starts = np.flatnonzero(ends) + 1
    return np.concatenate([[0], starts[starts < len(text)]]) if len(text) else np.empty(0, np.int64)


def cleaned(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text without technical noise, and the first and the end place in the source of each character that is left."""
    begin = np.arange(len(text))
    crlf = np.zeros(len(text), bool)
    crlf[:-1] = (text[:-1] == 0x0D) & (text[1:] == 0x0A)
    keep = ~np.isin(text, NOISE)
    keep[1:] &= ~crlf[:-1]
    out, begin, end = text[keep].copy(), begin[keep], (begin + 1 + crlf)[keep]
    out[np.isin(out, (0x0D, *BREAKING))] = 0x0A
    # Blanks that only a line end, or nothing, follows.
    solid = (out != 0x20) & (out != 0x09)
    ahead = np.append(np.where(solid, np.arange(len(out)), len(out)), len(out))
    ahead = np.minimum.accumulate(ahead[::-1])[::-1][:-1]
    keep = solid | (np.append(out, 0x0A)[ahead] != 0x0A)
    out, begin, end = out[keep], begin[keep], end[keep]
    # The number of line ends in a row up to each place.
    place, broken = np.arange(len(out)), out == 0x0A
    last = np.maximum.accumulate(np.where(broken, -1, place)) if len(out) else place
    keep = ~broken | ((place - last <= MOST_LINE_ENDS) & (last >= 0) & (place <= place[~broken].max(initial=-1)))
    return out[keep], begin[keep], end[keep]
