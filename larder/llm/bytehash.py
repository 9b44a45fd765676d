"""Rolling hashes of all spans of a byte string, in numpy.

The hash of a span is a polynomial modulo 2 to the 64 in random values of its bytes: two prefix sums give any span's, in whatever order.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.Generator(np.random.PCG64(2024)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 to the 64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Spans:
    """Hashes of spans [a, b) of ``data``."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[: len(data)])])

    def at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a])

    def rolling(self, k: int) -> np.ndarray:
        """Hashes of all spans of length k, by start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    pick = np.minimum if least else np.maximum
    fill = np.iinfo(x.dtype).max if least else 0
    blocks = np.concatenate([x, np.full(-len(x) % w, fill, x.dtype)]).reshape(-1, w)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return pick(behind[: len(x) - w + 1], ahead[w - 1 : len(x)])


def minimizers(grams: np.ndarray, w: int) -> np.ndarray:
    """Places whose gram is the least of some window of w, ties included."""
    lows = sliding(grams, w, True)
    pad = np.zeros(w - 1, grams.dtype)
    return np.nonzero(sliding(np.concatenate([pad, lows, pad]), w, False) == grams)[0] if len(lows) else np.zeros(0, np.int64)
