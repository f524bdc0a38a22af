"""Numbers of words and hashes of word windows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

#: Words remembered by one Python worker.
WORDS_KEPT = 200_000
#: Odd multipliers of the window polynomials.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Numbers(dict):
    """Word to a 64-bit number; a full memory starts anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def memory() -> _Numbers:
    return _Numbers()


def word_numbers(found: list[bytes]) -> np.ndarray:
    """A 64-bit number of every word, the same in every process."""
    return np.fromiter(map(memory().__getitem__, found), np.uint64, len(found))


def mix(values: np.ndarray, by: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(by)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def window_hashes(numbers: np.ndarray, size: int, multiplier: int = FIRST) -> np.ndarray:
    """A 64-bit hash of every window of ``size`` consecutive words, from windows of powers of two."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, at, span, power, part = np.zeros(n, np.uint64), 0, 1, multiplier, numbers
    while True:
        if size & span:
            total = total * np.uint64(power % 2**64) + part[at : at + n]
            at += span
        if span * 2 > size:
            return mix(total)
        part = part[:-span] * np.uint64(power % 2**64) + part[span:]
        span, power = span * 2, power * power % 2**64
