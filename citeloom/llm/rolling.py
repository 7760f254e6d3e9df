"""Fingerprints of all byte windows of a text in a few passes over arrays.

A polynomial over 64-bit integers: with running sums of ``value * base**i`` the
fingerprint of any window is a difference of two sums, moved to the origin by
the inverse power.
"""

import numpy as np

MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Fingerprints by one base; ``seed`` gives an independent family."""

    def __init__(self, seed: int = 1) -> None:
        state = mix(np.arange(257, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & MASK))
        self.values = state[:256]
        # 5 modulo 8: the powers of the base repeat as late as possible.
        self.base = int(state[256]) & ~7 | 5
        self._powers = np.ones(1, np.uint64)
        self._inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self._powers) < n:
            n += n // 4
            for name, base in (("_powers", self.base), ("_inverses", pow(self.base, -1, 1 << 64))):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums over ``data`` (uint8), one more than it has bytes."""
        self._reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self._powers[: len(data)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows ``[start, end)``."""
        return mix((sums[ends] - sums[starts]) * self._inverses[starts])


#: The family for words and shingles: one table of powers a worker.
TEXT = Rolling(2)
