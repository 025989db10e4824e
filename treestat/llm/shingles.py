"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of letters, digits and marks of the basic plane's word characters, in lower case. A shingle is
``size`` neighbouring words of one text; a text with fewer words, but at least one, is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
SLICE_CHARS = 2_000_000
_WORD_CHAR = np.array([chr(i).isalnum() or i == 95 for i in range(0x10000)])
_WORD_CHAR[-1] = True  # stands for what lies beyond the plane
_POWER = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value of each 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str], chars: int = SLICE_CHARS, most: int = 50_000) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` texts with about so many characters; a longer text is a range of its own."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < most and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and bounds: text i has the words bounds[i] to bounds[i + 1]."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _WORD_CHAR[np.minimum(codes, 0xFFFF)]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1)
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])
    if not len(first):
        return np.empty(0, np.uint64), bounds
    size = last - first
    kept = np.flatnonzero(inside)
    place = np.arange(len(kept)) - np.repeat(np.cumsum(size) - size, size)
    value = (codes[kept].astype(np.uint64) + np.uint64(1)) * _POWER[place & 63] + (place >> 6).astype(np.uint64)
    return mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64)), bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in text order, and their bounds."""
    n = np.diff(bounds)
    counts = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    total = int(out_bounds[-1])
    if not total:
        return np.empty(0, np.uint64), out_bounds
    start = np.repeat(bounds[:-1] - out_bounds[:-1], counts) + np.arange(total)
    end = np.repeat(bounds[1:], counts)
    out = np.zeros(total, np.uint64)
    for k in range(size):
        at = start + k
        w = np.where(at < end, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))
        out = out * _POWER[0] + w
    return mix(out), out_bounds


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of least over sum of greatest counts of two multisets of shingles; 0 if one is empty."""
    if not len(a) or not len(b):
        return 0.0
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    least = int(np.minimum(na[i], nb[j]).sum())
    return least / (len(a) + len(b) - least)
