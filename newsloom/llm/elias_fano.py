"""Non-decreasing whole numbers in near-minimal space, with random access.

Of n numbers up to u, the low floor(log2(u / n)) bits stand packed one after another;
the high parts are a bit vector with a one per number, so that number i's high part is
the position of the i-th one less i. That takes about 2 + log2(u / n) bits a number.
``select`` finds the i-th one from a sampled position and a byte scan behind it.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = "<QQBII"
# One sampled position for so many ones.
SAMPLE = 256
ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """The file form of non-decreasing non-negative numbers below 2**62."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    most = int(values[-1]) if n else 0
    low_bits = max(0, (most // n).bit_length() - 1) if n else 0
    high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    bits[high] = 1
    if low_bits:
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    else:
        low = np.zeros(0, np.uint8)
    vector = np.packbits(bits, bitorder="little").tobytes()
    packed = np.packbits(low, bitorder="little").tobytes()
    samples = high[::SAMPLE].astype("<u4").tobytes()
    return struct.pack(HEAD, n, most, low_bits, len(packed), len(vector)) + packed + vector + samples


class EliasFano:
    """Reader of one encoded sequence at the start of ``blob``; ``size`` is its length in bytes."""

    def __init__(self, blob: bytes | memoryview):
        blob = memoryview(blob)
        self.n, self.most, self.low_bits, low_size, high_size = struct.unpack_from(HEAD, blob)
        at = struct.calcsize(HEAD)
        self.low = np.frombuffer(blob, np.uint8, low_size, at)
        self.high = np.frombuffer(blob, np.uint8, high_size, at + low_size)
        count = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(blob, "<u4", count, at + low_size + high_size)
        self.size = at + low_size + high_size + 4 * count

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        first, bits = i * self.low_bits, self.low_bits
        window = self.low[first // 8 : (first + bits + 7) // 8].tobytes()
        return (int.from_bytes(window, "little") >> (first % 8)) & ((1 << bits) - 1)

    def select(self, i: int) -> int:
        """Position of the i-th one of the high bits."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := int(ONES[word])) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return ((self.select(i) - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        """Every number, in order."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        weights = np.int64(1) << np.arange(self.low_bits, dtype=np.int64)
        return high + bits.astype(np.int64) @ weights
