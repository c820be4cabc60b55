"""Elias-Fano coding of a non-decreasing sequence, with a select structure over its upper bits.

n values below u take about n * (2 + log2(u / n)) bits. The lower bits of all values stand in one packed array;
the upper bits are unary: value i sets bit (value >> low) + i. select() finds the i-th set bit from a sample of
every SAMPLE-th one and the bits in between, so no table of 64-bit offsets is kept; select_range() does so for a run of values, reading the
stretch between two samples alone.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBxxxxxxx")


class EliasFano:
    def __init__(self, n: int, universe: int, low: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low, self.lower, self.upper, self.samples = n, universe, low, lower, upper, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """values: non-negative and non-decreasing."""
        v = np.asarray(values, np.uint64)
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 1
        low = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1) if low else np.zeros((n, 0), np.uint64)
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, universe, low, np.packbits(bits.astype(np.uint8), bitorder="little"), np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_range(i, i + 1)[0])

    def select_range(self, lo: int, hi: int) -> np.ndarray:
        """The values lo to hi - 1, as int64."""
        if hi <= lo:
            return np.zeros(0, np.int64)
        first, last = lo // SAMPLE, (hi - 1) // SAMPLE + 1
        begin = int(self.samples[first])
        stop = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.upper)
        byte = begin >> 3
        ones = np.flatnonzero(np.unpackbits(self.upper[byte : (stop + 7) // 8], bitorder="little")) + 8 * byte
        skip = int(np.searchsorted(ones, begin)) + lo - first * SAMPLE
        high = ones[skip : skip + hi - lo] - np.arange(lo, hi)
        if not self.low:
            return high
        at = lo * self.low
        bits = np.unpackbits(self.lower[at // 8 : (hi * self.low + 7) // 8], bitorder="little")[at % 8 : at % 8 + (hi - lo) * self.low]
        return (high << self.low) + (bits.reshape(-1, self.low).astype(np.int64) << np.arange(self.low)).sum(axis=1)

    def all(self) -> np.ndarray:
        """Every value, as int64."""
        return self.select_range(0, self.n)

    def to_bytes(self) -> bytes:
        parts = [self.lower.tobytes(), self.upper.tobytes(), self.samples.astype("<u4").tobytes()]
        return _HEAD.pack(self.n, self.universe, self.low) + struct.pack("<3Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes | memoryview, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that starts at `at`, and where it ends."""
        n, universe, low = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        sizes = struct.unpack_from("<3Q", data, at)
        at += 24
        parts = []
        for kind, size in zip((np.uint8, np.uint8, np.dtype("<u4")), sizes, strict=True):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, universe, low, *parts), at
