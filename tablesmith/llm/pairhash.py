"""Minimal perfect hashing of distinct 64-bit keys with numpy.

Level by level the keys that are left are thrown into an array of bits somewhat larger than their number. A key alone in
its place is settled there; the others go on to the next level. A settled key's index is the rank of its bit, so n keys
get the indexes 0 to n - 1. About 4 bits a key; a key that was not in the set may get any index, so callers keep the
keys in index order and compare.
"""

from __future__ import annotations

import numpy as np

#: Places for each key of a level, and levels before the rest is simply listed.
SPREAD, LEVELS = 1.5, 48


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mixed(keys.astype(np.uint64) + salt) % np.uint64(size)).astype(np.int64)


class PairHash:
    """An index 0 to n - 1 for each of n distinct keys."""

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray) -> None:
        self.bits, self.rest = bits, rest
        starts = np.cumsum([0] + [int(b.sum()) for b in bits])
        self.ranks = [np.cumsum(b, dtype=np.int64) - 1 + s for b, s in zip(bits, starts)]
        self.listed = int(starts[-1])
        self.size = self.listed + len(rest)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PairHash":
        """``keys``: distinct 64-bit integers."""
        left, bits = np.asarray(keys, dtype=np.int64), []
        while len(left) and len(bits) < LEVELS:
            size = max(8, int(len(left) * SPREAD))
            at = _places(left, len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            left = left[~alone[at]]
        return cls(bits, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for some keys that are not in the set, any index for others."""
        keys = np.asarray(keys, dtype=np.int64)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            if not len(open_):
                return out
            at = _places(keys[open_], level, len(bits))
            here = bits[at]
            out[open_[here]] = ranks[at[here]]
            open_ = open_[~here]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            here = self.rest[at] == keys[open_]
            out[open_[here]] = self.listed + at[here]
        return out

    def ordered(self, keys: np.ndarray) -> np.ndarray:
        """The set's ``keys`` in index order."""
        out = np.empty(self.size, dtype=np.int64)
        out[self.index(keys)] = keys
        return out

    def verified(self, keys: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for keys that are not in the set; ``stored``: the set's keys in index order."""
        at = self.index(keys)
        return np.where((at >= 0) & (stored[np.maximum(at, 0)] == keys), at, -1) if len(stored) else np.full(len(keys), -1, dtype=np.int64)

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.bits), len(self.rest), *[len(b) for b in self.bits]], dtype=np.int64)
        return b"".join([sizes.tobytes(), self.rest.astype(np.int64).tobytes(), *[np.packbits(b).tobytes() for b in self.bits]])

    @classmethod
    def from_bytes(cls, data: bytes) -> "PairHash":
        levels, rest = np.frombuffer(data, dtype=np.int64, count=2).tolist()
        sizes = np.frombuffer(data, dtype=np.int64, count=levels, offset=16).tolist()
        at = 16 + 8 * levels
        left = np.frombuffer(data, dtype=np.int64, count=rest, offset=at)
        at, bits = at + 8 * rest, []
        for size in sizes:
            packed = np.frombuffer(data, dtype=np.uint8, count=(size + 7) // 8, offset=at)
            bits.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(bits, left)
