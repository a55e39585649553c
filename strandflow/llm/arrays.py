"""Numpy helpers for text columns inside tasks: code points of many texts at once, spans and their hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def blocks(texts: list[str], limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of consecutive texts of at most limit characters together, or of one longer text."""
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text starts (with the end of the last)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), starts


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    return _powers(1 << max(19, int(n + 1).bit_length()))


class Hasher:
    """64-bit hashes of any spans of one array, each in constant time (a polynomial modulo 2^64 over scattered values)."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = powers(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def runs(member: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that cross no text's border: start, end and the number of the text."""
    edge = np.zeros(len(member) + 1, bool)
    edge[starts] = True
    before = np.empty(len(member) + 1, bool)
    before[0], before[1:] = False, member
    inside = np.append(member, False)
    s = np.flatnonzero(inside & (~before | edge))
    e = np.flatnonzero(before & (~inside | edge))
    return s, e, np.searchsorted(starts, s, "right") - 1


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
