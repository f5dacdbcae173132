"""64-bit codes of words and word runs, for whole batches of texts at once.

A word's code is a polynomial over random values of its bytes modulo 2**64, taken from one running sum over the batch and
scattered afterwards. Codes depend on the word only: they are the same on every machine and in every run.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of a batch that are summed at once; what that needs is some 50 times as much.
SEGMENT = 1 << 19


def scatter(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads out close ones (the finishing steps of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def separators() -> np.ndarray:
    """By byte: whether it is white space (blank, or tab to carriage return)."""
    out = np.zeros(256, bool)
    out[[32, *range(9, 14)]] = True
    return out


@cache
def byte_values(lower: bool) -> np.ndarray:
    values = scatter(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if lower:
        values[65:91] = values[97:123]
    return values


@cache
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(size: int, base: int) -> np.ndarray:
    return _powers(max(SEGMENT + 1, 1 << (int(size) - 1).bit_length()), base)[:size]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (one more entry at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separators()[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Codes of the words data[start:end], which come in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        a = starts[k]
        m = max(k + 1, int(np.searchsorted(ends, a + SEGMENT, side="right")))
        b = ends[m - 1]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(byte_values(lower)[data[a:b]] * powers(b - a, _BASE), out=sums[1:])
        s, e = starts[k:m] - a, ends[k:m] - a
        out[k:m] = (sums[e] - sums[s]) * powers(b - a, _INVERSE)[s] + (e - s).astype(np.uint64)
        k = m
    return scatter(out)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, and each text's first word (one more entry at the end)."""
    starts, ends, first = word_spans(data, offsets)
    return span_codes(data, starts, ends, lower), first


@cache
def _weights(size: int) -> np.ndarray:
    return scatter(np.arange(7, 7 + size, dtype=np.uint64)) | np.uint64(1)


def runs(codes: np.ndarray, size: int) -> np.ndarray:
    """Codes of all runs of `size` words; len(codes) - size + 1 of them, or none."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, w in enumerate(_weights(size)):
        out += codes[j : j + n] * w
    return scatter(out)


def shingle_set(codes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct codes of a text's runs of `size` words; of all of its words if it has fewer; none without words."""
    if not len(codes):
        return codes
    if len(codes) < size:
        return runs(codes, len(codes)) ^ np.uint64(len(codes))  # apart from words and longer runs
    return np.unique(runs(codes, size))
