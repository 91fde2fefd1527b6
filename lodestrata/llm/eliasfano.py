"""Elias-Fano coding of a monotone sequence, with select.

Values are split into ``low`` bits, packed, and a unary-coded upper part in which the i-th one bit
stands at ``(value_i >> low) + i``. The place of every ``SAMPLE``-th one bit is stored beside it, in
bytes as few as the longest needs. ``select`` jumps to a stored place and counts ones in machine words
from there, so opening a sequence reads its head alone and builds no table, and the sequence takes about
``2 + log2(universe / n)`` bits a value and ``32 / SAMPLE`` for the places.

Values are at least 0 and less than 2**64; values may repeat; an empty sequence is one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBB")


def encode(values: np.ndarray) -> bytes:
    """Bytes of the non-decreasing unsigned ``values``."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if n and np.any(values[1:] < values[:-1]):
        raise ValueError("the sequence decreases")
    universe = int(values[-1]) + 1 if n else 0
    low = min(63, max(0, (universe // n).bit_length() - 1)) if n else 0
    ones = ((values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
    marks = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
    marks[ones] = 1
    if low:
        shifts = np.arange(low, dtype=np.uint64)
        bits = ((values[:, None] >> shifts[None, :]) & np.uint64(1)).astype(np.uint8).ravel()
    else:
        bits = np.zeros(0, dtype=np.uint8)
    high = np.packbits(marks, bitorder="little").tobytes()
    width = (len(marks).bit_length() + 7) // 8
    places = b"".join([int(p).to_bytes(width, "little") for p in ones[::SAMPLE]])
    return _HEAD.pack(n, len(high), low, width) + places + high + np.packbits(bits, bitorder="little").tobytes()


class EliasFano:
    """Reader of what ``encode`` made, in place."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        self.n, high, self.low, self.width = _HEAD.unpack_from(data, 0)
        self.places = _HEAD.size
        self.high = self.places + -(-self.n // SAMPLE) * self.width
        self.lows = self.high + high
        self.size = self.lows + (self.n * self.low + 7) // 8

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = self.places + i // SAMPLE * self.width
        place = int.from_bytes(self.data[at : at + self.width], "little")
        left = i % SAMPLE
        byte = self.high + place // 8
        word = int.from_bytes(self.data[byte : min(byte + 8, self.lows)], "little") >> place % 8 << place % 8
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 8
            word = int.from_bytes(self.data[byte : min(byte + 8, self.lows)], "little")
        half = 32
        while half:  # the place of the one bit with ``left`` ones before it
            below = word & (1 << half) - 1
            if (ones := below.bit_count()) <= left:
                left, word, byte_bits = left - ones, word >> half, half
            else:
                word, byte_bits = below, 0
            place = byte_bits if half == 32 else place + byte_bits
            half //= 2
        return ((byte - self.high) * 8 + place - i) << self.low | self._low(i)

    def _low(self, i: int) -> int:
        first = i * self.low
        last = first + self.low
        word = int.from_bytes(self.data[self.lows + first // 8 : self.lows + (last + 7) // 8], "little")
        return word >> first % 8 & (1 << self.low) - 1

    def __iter__(self) -> Iterator[int]:
        """Every value in order, each by ``select``."""
        return map(self.select, range(self.n))
