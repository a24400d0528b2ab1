"""Public 64-bit generators, for draws that must repeat on any machine: SplitMix64 and xoshiro256**."""

from __future__ import annotations

from math import e, factorial, log, sqrt

import numpy as np

_WORD = (1 << 64) - 1


def splitmix64(seed: int):
    """An endless stream of 64-bit words."""
    state = seed & _WORD
    while True:
        state = (state + 0x9E3779B97F4A7C15) & _WORD
        z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 & _WORD
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _WORD
        yield z ^ z >> 31


def words(seed: int, replica: int, places: np.ndarray) -> np.ndarray:
    """The words at some places (from 0) of the SplitMix64 stream that the mixed sum of seed and replica seeds."""
    state = _mixed(np.array([(seed + replica) & _WORD], dtype=np.uint64))
    return _mixed(state + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def draws(seed: int, replica: int, n: int) -> np.ndarray:
    """n places out of 0..n - 1 with repetition, from the words of the replica."""
    return (words(seed, replica, np.arange(n)) % np.uint64(n)).astype(np.int64)


#: Chances that a Poisson number of mean 1 is at most 0, 1, 2, …
_UP_TO = np.cumsum([1 / (e * factorial(k)) for k in range(18)])


def counts(seed: int, replica: int, places: np.ndarray) -> np.ndarray:
    """Poisson numbers of mean 1 for some places, from the words of the replica: how often a row comes, if rows are drawn on their own."""
    return np.searchsorted(_UP_TO, (words(seed, replica, places) >> np.uint64(11)) * 2.0**-53, side="right").astype(float)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


class Xoshiro256:
    """xoshiro256** with a state of four words, or seeded through SplitMix64."""

    def __init__(self, seed: int | tuple[int, int, int, int]):
        words = splitmix64(seed) if isinstance(seed, int) else iter(seed)
        self.state = [next(words) for _ in range(4)]

    @staticmethod
    def _turn(x: int, by: int) -> int:
        return (x << by | x >> 64 - by) & _WORD

    def word(self) -> int:
        a, b, c, d = self.state
        out = self._turn(b * 5 & _WORD, 7) * 9 & _WORD
        c, d = c ^ a, d ^ b
        self.state = [a ^ d, b ^ c, c ^ (b << 17 & _WORD), self._turn(d, 45)]
        return out

    def uniform(self) -> float:
        """A double in [0, 1) from the top 53 bits."""
        return (self.word() >> 11) * 2.0**-53

    def below(self, n: int) -> int:
        """An integer in 0..n - 1 without bias: words beyond the last whole multiple of n are drawn again."""
        limit = (1 << 64) - (1 << 64) % n
        while (w := self.word()) >= limit:
            pass
        return w % n

    def normal(self) -> float:
        """A standard normal by the polar method."""
        while True:
            u, v = 2 * self.uniform() - 1, 2 * self.uniform() - 1
            s = u * u + v * v
            if 0 < s < 1:
                return u * sqrt(-2 * log(s) / s)
