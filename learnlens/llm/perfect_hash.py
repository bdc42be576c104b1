"""Minimal perfect hashing of distinct 64-bit keys.

Level by level the keys that are left are hashed into a bit array of ``SPREAD`` bits each; those that are
alone in their place set its bit, the others go to the next level.  The number of a key is the number of
bits set before its own, so n keys get the numbers 0 to n - 1.  A table of the keys by number tells
keys that were never put in from those that were.
"""

from __future__ import annotations

import numpy as np

from learnlens.llm.shared import expanded, squeezed

SPREAD = 2


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        """``keys``: distinct, as uint64."""
        self.levels: list[np.ndarray] = []
        left = keys
        while len(left):
            place = _mixed(left, len(self.levels)) % np.uint64(SPREAD * len(left))
            times = np.bincount(place.astype(np.int64), minlength=SPREAD * len(left))
            self.levels.append(times == 1)
            left = left[times[place.astype(np.int64)] > 1]
        self._ranked()
        self.keys = np.empty(len(keys), np.uint64)
        self.keys[self._numbers(keys)] = keys

    def _ranked(self) -> None:
        self.before, seen = [], 0
        for bits in self.levels:
            self.before.append(seen + np.cumsum(bits) - bits)
            seen += int(bits.sum())

    def __len__(self) -> int:
        return len(self.keys)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        number = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            place = (_mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            there = bits[place]
            number[left[there]] = before[place[there]]
            left = left[~there]
        return number

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, verified; -1 for a key that was never put in."""
        number = self._numbers(keys)
        if not len(self.keys):
            return number
        return np.where((number >= 0) & (self.keys[number] == keys), number, -1)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.keys), len(self.levels), *map(len, self.levels)], "<u8")
        bits = b"".join(np.packbits(level).tobytes() for level in self.levels)
        return squeezed(head.tobytes() + self.keys.astype("<u8").tobytes() + bits)

    @classmethod
    def from_bytes(cls, raw) -> PerfectHash:
        raw = expanded(raw)
        made = cls.__new__(cls)
        count, levels = np.frombuffer(raw, "<u8", 2).tolist()
        sizes = np.frombuffer(raw, "<u8", levels, 16).tolist()
        at = 16 + 8 * levels
        made.keys = np.frombuffer(raw, "<u8", count, at)
        at += 8 * count
        made.levels = []
        for size in sizes:
            width = -(-size // 8)
            made.levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=size).astype(bool))
            at += width
        made._ranked()
        return made
