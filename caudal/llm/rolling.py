"""Running (Karp-Rabin) hashes of byte and token sequences, whole batches at a time."""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[:1] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[base] = tuple(out)
    up, down = _POWERS[base]
    return up[:n], down[:n]


class Rolling:
    """Polynomial hash of any slice of ``data``, from prefix sums."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = _powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]

    def every(self, k: int) -> np.ndarray:
        return (self.sums[k:] - self.sums[:-k]) * self.down[:len(self.sums) - k]


def grams(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` successive token hashes."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = tokens[:n].copy()
    for i in range(1, k):
        h = mix(h * np.uint64(BASES[1]) + tokens[i:n + i])
    return h
