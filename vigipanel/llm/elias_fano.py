"""Elias-Fano code of a rising sequence, with select samples."""

from __future__ import annotations

import struct

import numpy as np

# The place of every SAMPLE-th one of the high bits is stored, so select reads a short stretch.
SAMPLE = 256
HEAD = struct.Struct("<QQBQQ")  # values, universe, low bits, bytes of low part, bytes of high part


class EliasFano:
    """`n` values in 0..universe, none below its predecessor, in about n * (2 + log2(u / n)) bits.

    Each value is cut into `low` fixed bits and a high part; the high parts are written in
    unary into one bit string, where value i is the i-th one at place (value >> low) + i.
    """

    def __init__(self, n: int, universe: int, low: int, lows: bytes, highs: bytes, samples: bytes):
        self.n, self.universe, self.low = n, universe, low
        self.lows, self.highs = lows, highs
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, "<u8")
        n = len(values)
        low = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low, dtype="<u8")) & 1
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros(n + (universe >> low) + 1, np.uint8)
        unary[places] = 1
        highs = np.packbits(unary, bitorder="little").tobytes()
        return cls(n, universe, low, lows, highs, places[::SAMPLE].astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        head = HEAD.pack(self.n, self.universe, self.low, len(self.lows), len(self.highs))
        return head + self.lows + self.highs + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, universe, low, n_low, n_high = HEAD.unpack_from(data)
        a, b = HEAD.size + n_low, HEAD.size + n_low + n_high
        return cls(n, universe, low, data[HEAD.size : a], data[a:b], data[b:])

    def _low(self, i: int) -> int:
        first, last = i * self.low, (i + 1) * self.low
        word = int.from_bytes(self.lows[first >> 3 : (last + 7) >> 3], "little")
        return (word >> (first & 7)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """Value i, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        ones = self.highs[byte] >> (place & 7) << (place & 7)
        while left >= ones.bit_count():
            left -= ones.bit_count()
            byte += 1
            ones = self.highs[byte]
        for _ in range(left):
            ones &= ones - 1
        place = byte * 8 + (ones & -ones).bit_length() - 1
        return (place - i) << self.low | self._low(i)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little"))
        high = (places[: self.n] - np.arange(self.n)).astype("<u8") << np.uint64(self.low)
        bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little")
        bits = bits[: self.n * self.low].reshape(self.n, self.low).astype("<u8")
        return high | (bits << np.arange(self.low, dtype="<u8")).sum(1, dtype="<u8")
