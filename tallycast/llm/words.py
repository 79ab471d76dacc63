"""Array kernel for texts: words as hashes, and hashed word shingles, without a Python loop over words.

A batch of texts becomes one array of code points. A word is a maximal run of letters, digits and
marks after lower-casing. Its 64-bit hash is a polynomial over mixed code points, taken from one
running sum; all arithmetic wraps at 2**64, so results are the same on any machine.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: A lone surrogate never occurs in a Spark string, so it can stand between texts.
SEP = "\ud800"
SEP_CODE = 0xD800

BASE = 0x9E3779B97F4A7C55
BASE_INV = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)
SHINGLE = 5
#: Code points of one array step.
STEP_CHARS = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit words."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def word_table() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@lru_cache(1)
def code_table() -> np.ndarray:
    return mix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64))


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = BASE, BASE_INV
    return np.cumprod(up), np.cumprod(down)


def steps(texts: list[str], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about `most` code points together; a longer text stands alone."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def fold(text: str) -> str:
    """Lower case of the same length, so that positions stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def code_points(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Words:
    """Words of a list of texts: first[d]:first[d + 1] are those of text d; start and end are positions in the joined text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def _edges(cp: np.ndarray) -> np.ndarray:
    """1 where a word starts, -1 where one has ended."""
    inside = np.zeros(len(cp) + 2, np.int8)
    inside[1:-1] = word_table()[cp]
    return np.diff(inside)


def word_starts(texts: list[str]) -> np.ndarray:
    """Positions in the texts, joined by SEP, where their words start; lower-casing makes or breaks no word."""
    return np.flatnonzero(_edges(code_points(SEP.join(texts))) == 1)


def words_of(texts: list[str]) -> Words:
    """Words of texts that together fit one array step."""
    cp = code_points(SEP.join(map(fold, texts)))
    n = len(cp)
    edge = _edges(cp)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(16, int(n + 1).bit_length())
    up, down = powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code_table()[cp] * up[:n], out=total[1:])
    value = mix((total[end] - total[start]) * down[start])
    begin = np.concatenate(([0], np.flatnonzero(cp == SEP_CODE) + 1)) if texts else np.zeros(0, np.int64)
    first = np.append(np.searchsorted(start, begin), len(start))
    return Words(start, end, value, first)


def shingles_of(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and first offsets by text; a text of fewer words has one shingle of all of them."""
    n, count = len(w.hash), w.count
    rolled = np.zeros(n, np.uint64)
    if n >= k:
        for j in range(k):
            rolled[: n - k + 1] = rolled[: n - k + 1] * STEP + w.hash[j : n - k + 1 + j]
    each = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    offsets = np.concatenate(([0], np.cumsum(each)))
    at = np.repeat(w.first[:-1] - offsets[:-1], each) + np.arange(offsets[-1])
    out = mix(rolled[at])
    for d in np.flatnonzero((count > 0) & (count < k)):
        h = count[d : d + 1].astype(np.uint64)
        for i in range(w.first[d], w.first[d + 1]):
            h = h * STEP + w.hash[i : i + 1]
        out[offsets[d]] = mix(h)[0]
    return out, offsets
