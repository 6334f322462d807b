"""Words and hashed word shingles of whole texts.

Words are maximal runs of bytes other than ASCII white space; A to Z are lowered
where asked, nothing else changes.
"""

from __future__ import annotations

import numpy as np

_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
# A random number for each byte, none for white space.
_BYTES = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, np.uint64)
_BYTES[_SPACE] = 0


def words(text: bytes, lower: bool = True) -> list[bytes]:
    return text.lower().split() if lower else text.split()


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as asked for."""

    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def of(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            size = 1 << max(16, (count - 1).bit_length())
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes' random numbers, for all
    words of the text at once, brought to a common origin and scrambled."""
    data = np.frombuffer(text.lower() if lower else text, np.uint8)
    solid = ~_SPACE[data]
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    if len(solid) and solid[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.of(len(data))
    return mix(np.add.reduceat(_BYTES[data] * up[: len(data)], starts) * down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words; a shorter text is one run."""
    if len(hashes) == 0:
        return hashes
    width = min(k, len(hashes))
    count = len(hashes) - width + 1
    total = np.full(count, np.uint64(width), np.uint64)
    for i in range(width):
        total = total * _GOLD + hashes[i : i + count]
    return mix(total)


def shingle_set(text: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's ``k``-word shingles."""
    hashes = np.sort(rolling(word_hashes(text), k))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    return hashes[fresh]
