"""Elias-Fano coding of non-decreasing integers.

A value is cut into `low` bits, packed side by side, and a high part, written in unary into a
bitmap: value i sets bit (high_i + i). That takes about 2 + log2(universe / n) bits a value.
`select` finds value i from a 32-bit sample of every 256th set bit, without a 64-bit table.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<QqBQI")  # values, base, low bits, bytes of bitmap, samples
SAMPLE = 256


def encode(values: np.ndarray) -> bytes:
    """values: non-decreasing int64 or uint64 whose span is under 2**63."""
    values = np.asarray(values)
    n = len(values)
    if not n:
        return HEAD.pack(0, 0, 0, 0, 0)
    base = int(values[0])
    rest = (values - values[0]).astype(np.uint64)
    low = max(0, (int(rest[-1]) // n).bit_length() - 1)
    high = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1, np.uint8)
    bits[high] = 1
    upper = np.packbits(bits, bitorder="little").tobytes()
    plane = np.zeros((n, low), np.uint8)
    for b in range(low):
        plane[:, b] = (rest >> np.uint64(b)).astype(np.uint8) & 1
    lower = np.packbits(plane.ravel(), bitorder="little").tobytes()
    samples = high[::SAMPLE].astype("<u4").tobytes()
    return b"".join((HEAD.pack(n, base, low, len(upper), len(samples) // 4), samples, upper, lower))


class Sequence:
    """Reads one coded sequence out of a buffer."""

    def __init__(self, buffer) -> None:
        self.n, self.base, self.low, upper, samples = HEAD.unpack_from(buffer)
        at = HEAD.size
        self.samples = np.frombuffer(buffer, "<u4", samples, at)
        at += 4 * samples
        self.upper = np.frombuffer(buffer, np.uint8, upper, at)
        at += upper
        self.lower = np.frombuffer(buffer, np.uint8, (self.n * self.low + 7) // 8, at)
        self.size = at + len(self.lower)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Value i, reading only the bytes near it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        skip = at % 8
        while True:
            block = np.unpackbits(self.upper[byte : byte + 64], bitorder="little")
            block[:skip] = 0
            ones = np.flatnonzero(block)
            if left < len(ones):
                high = byte * 8 + int(ones[left]) - i
                break
            left -= len(ones)
            byte, skip = byte + 64, 0
        value = high << self.low
        for b in range(self.low):
            bit = i * self.low + b
            value |= (int(self.lower[bit // 8]) >> (bit % 8) & 1) << b
        return self.base + value

    def some(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, reading only the bytes between their samples."""
        if not 0 <= i < j <= self.n:
            return np.zeros(0, np.int64)
        first = i // SAMPLE
        byte = int(self.samples[first]) // 8
        last = -(-j // SAMPLE)
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.upper)
        at = np.flatnonzero(np.unpackbits(self.upper[byte:end], bitorder="little")) + byte * 8
        at = at[np.searchsorted(at, int(self.samples[first])) :][i - first * SAMPLE : j - first * SAMPLE]
        value = (at - np.arange(i, j)).astype(np.int64) << self.low
        if self.low:
            byte = i * self.low // 8
            skip = i * self.low - byte * 8
            plane = np.unpackbits(self.lower[byte : (j * self.low + 7) // 8], bitorder="little")[skip : skip + (j - i) * self.low].reshape(j - i, self.low)
            for b in range(self.low):
                value |= plane[:, b].astype(np.int64) << b
        return value + self.base

    def all(self) -> np.ndarray:
        return self.some(0, self.n)
