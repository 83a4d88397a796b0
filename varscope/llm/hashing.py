"""Numpy on the units (bytes or words) of many texts at once: prefix hashes, windows, minimizers.

A text's prefix hash is a polynomial modulo 2^64; the hash of any stretch follows from two of
its values, so equal stretches have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes (a bijection)."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Prefix:
    """Prefix hashes of a row of unit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.n = n
        self.inv = powers(n + 1)[1]
        self.h = np.zeros(n + 1, U)
        np.cumsum((values.astype(U) + U(1)) * powers(n + 1)[0][:n], out=self.h[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, end)."""
        return (self.h[end] - self.h[start]) * self.inv[start]

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all windows of ``k`` units, by start."""
        if self.n < k:
            return np.zeros(0, U)
        return mix((self.h[k:] - self.h[:-k]) * self.inv[:self.n - k + 1])


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of texts: byte ranges, the text of each, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)          # a text begins here
        edge[offsets] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:n]
        self.data, self.solid = data, solid
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.start, offsets)        # words before each text
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.offsets))
        size = self.end - self.start
        self.hash = mix(Prefix(data).of(self.start, self.end) + size.astype(U) * U(0xA0761D6478BD642F))


def window_starts(offsets: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of ``length`` units that lie within one text."""
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    return np.arange(n.sum()) + np.repeat(offsets[:-1] - (np.cumsum(n) - n), n)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    if n < w:
        return x[:0]
    pad = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def anchors(grams: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """The seed of every window: of the windows of ``seed`` units inside a window of ``length``,
    the leftmost with the least hash. Equal windows have their seed at the same place.
    Returns seeds and the first and last window of each, all as starts."""
    starts = window_starts(offsets, length)
    key = (grams >> U(32) << U(32)) | np.arange(len(grams), dtype=U)
    at = (sliding_min(key, length - seed + 1)[starts] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return at[new], starts[new], starts[np.append(new[1:], len(starts)) - 1] if len(new) else starts[:0]


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a window of ``length`` that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values
