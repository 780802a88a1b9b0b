"""Elias-Fano sequences: a non-decreasing sequence in about 2 + log2(range / length) bits a value."""

from __future__ import annotations

import struct

import numpy as np

#: Bits of the upper part that share one counter of the select structure.
BLOCK = 512


class EliasFano:
    """Low bits packed, high parts in unary; a counter every BLOCK bits lets select find any value."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.counts = n, low_bits, low, high, counts

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """values: non-decreasing, not negative."""
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        upper = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(upper[-1]) + 1 if n else 0) // BLOCK) * BLOCK, dtype=np.uint8)
        bits[upper] = 1
        counts = np.concatenate(([0], np.cumsum(bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)))).astype("<u4")
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), counts)

    def select(self, i: int) -> int:
        """Value number i, from one counter, one block of upper bits and its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.counts, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        at = block * BLOCK + int(np.flatnonzero(bits)[i - int(self.counts[block])])
        low = 0
        for k in range(self.low_bits):
            b = i * self.low_bits + k
            low |= (int(self.low[b >> 3]) >> (b & 7) & 1) << k
        return (at - i) << self.low_bits | low

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1, from the blocks of upper bits that hold them and their low bits."""
        a, b = max(0, a), min(b, self.n)
        if a >= b:
            return np.zeros(0, dtype=np.uint64)
        first, last = (int(x) - 1 for x in np.searchsorted(self.counts, [a, b - 1], side="right"))
        bits = np.unpackbits(self.high[first * BLOCK // 8 : (last + 1) * BLOCK // 8], bitorder="little")
        skip = a - int(self.counts[first])
        at = np.flatnonzero(bits)[skip : skip + b - a] + first * BLOCK
        out = (at - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            start, end = a * self.low_bits, b * self.low_bits
            low = np.unpackbits(self.low[start // 8 : -(-end // 8)], bitorder="little")
            low = low[start % 8 : start % 8 + end - start].reshape(b - a, self.low_bits)
            for k in range(self.low_bits):
                out |= low[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def values(self) -> np.ndarray:
        """All of them."""
        return self.slice(0, self.n)

    HEAD = struct.Struct("<QIQQQ")

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.counts.tobytes()]
        return self.HEAD.pack(self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b, c = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        low, high = (np.frombuffer(data, np.uint8, x, y) for x, y in ((a, at), (b, at + a)))
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", c // 4, at + a + b))
