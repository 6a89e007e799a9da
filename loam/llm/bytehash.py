"""Vectorised hashes of byte strings and words."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers of the mixing functions.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BASE = 0x100000001B3
MASK64 = (1 << 64) - 1
MASK56 = np.uint64((1 << 56) - 1)
#: Random values of the bytes, for two independent hashes.
_TABLES = [np.random.default_rng(k).integers(1, 1 << 63, 256, dtype=np.uint64) for k in (11, 12)]
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    return x ^ (x >> np.uint64(27))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse ** k, modulo 2 ** 64, for k below n at least."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        for i, b in enumerate((BASE, inverse)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Prefix:
    """Hash of any slice of a byte buffer from running sums; ``which`` tells two independent ones apart."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_TABLES[which][raw] * up[: len(raw)], dtype=np.uint64, out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [begin, end); slices of different length are told apart by their length."""
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * M1)


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of every stretch of equal neighbours."""
    if not len(values):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist()
    return list(zip(cuts, [*cuts[1:], len(values)], strict=True))
