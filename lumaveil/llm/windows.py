"""Repeated windows of a fixed number of units (words or bytes) across documents, exactly, in bounded groups.

Of the k-grams of a window the one with the smallest hash (the leftmost such) is its anchor; equal windows have equal
anchors at equal offsets. Neighbouring windows with one anchor form a segment. A segment whose anchor occurs nowhere
else holds no repeated window. Hashes are 64-bit sums over hashes of units, taken for any range from running sums; they
tell where to look, and texts are compared unit by unit.
"""

from __future__ import annotations

import re

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = np.uint64((1 << 24) - 1)
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, b in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Sums:
    """Hashes of ranges of a sequence of 64-bit unit values."""

    def __init__(self, units: np.ndarray):
        up, self.down = powers(len(units) + 1)
        self.total = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.total[k:] - self.total[:n]) * self.down[:n])


def segments(units: np.ndarray, bounds: np.ndarray, width: int, k: int):
    """(document, first window, windows, anchor hash, content hash) of all segments; bounds: documents' first units.

    Windows are positions in units, counted from the first unit of all.
    """
    sums = Sums(units)
    gram = sums.grams(k)
    span = width - k + 1
    n = len(units) - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), sums
    low = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
    have = 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    anchor = (low[:n] & PLACE).astype(np.int32)
    del low
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    inside = doc[:n] == doc[width - 1 :]
    first = np.flatnonzero(inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:n] != doc[: n - 1]) | ~inside[:-1]]))
    stop = np.concatenate([[False], (anchor[1:] != anchor[:-1]) | (doc[1:n] != doc[: n - 1]) | ~inside[1:]])
    ends = np.flatnonzero(stop | ~inside)
    ends = np.append(ends, n)
    last = ends[np.searchsorted(ends, first, side="right")]
    return doc[first], first, last - first, gram[anchor[first]], sums.of(first, last + width - 1), sums
