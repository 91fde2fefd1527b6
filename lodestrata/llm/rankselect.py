"""A bitvector with rank and select, from bits packed 64 to a word and one running count a block of words.

``rank(p)`` counts the ones before bit p and ``select(k)`` finds the k-th one, both for arrays of queries: a block
is found in the directory of counts, then at most ``BLOCK`` words and one word's bits are looked at.
"""

from __future__ import annotations

import numpy as np

#: Words of a block; the directory holds 64 bits for each.
BLOCK = 8
_ONE, _LOW = np.uint64(1), np.uint64(63)


class Bits:
    def __init__(self, bits: np.ndarray):
        """``bits``: booleans, of which only the packed form stays."""
        self.n_bits = len(bits)
        blocks = -(-len(bits) // (64 * BLOCK)) + 1  # the last block is empty, so that rank(n_bits) has one
        packed = np.zeros(blocks * BLOCK * 8, np.uint8)
        own = np.packbits(bits, bitorder="little")
        packed[: len(own)] = own
        self.words = packed.view("<u8")
        self.directory = np.zeros(blocks + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words).reshape(blocks, BLOCK).sum(axis=1, dtype=np.int64), out=self.directory[1:])
        self.ones = int(self.directory[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each bit of ``at``, from 0 to n_bits."""
        at = np.asarray(at, np.int64)
        word = at >> 6
        block = word // BLOCK
        count = self.directory[block]
        for k in range(BLOCK - 1):
            w = block * BLOCK + k
            count = count + np.where(w < word, np.bitwise_count(self.words[w]), 0)
        below = (_ONE << (at.astype(np.uint64) & _LOW)) - _ONE
        return count + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Bit of the k-th one, counted from 0; n_bits if there are not so many."""
        k = np.asarray(k, np.int64)
        known = k < self.ones
        left = np.where(known, k, 0)
        block = np.minimum(np.searchsorted(self.directory, left, "right") - 1, len(self.directory) - 2)
        left = left - self.directory[block]
        word, done = block * BLOCK, np.zeros(k.shape, bool)
        for _ in range(BLOCK - 1):
            count = np.bitwise_count(self.words[word]).astype(np.int64)
            done |= left < count
            left = np.where(done, left, left - count)
            word = np.where(done, word, word + 1)
        # halves of the word: 32, 16 ... 1 bits
        rest, bit = self.words[word], np.zeros(k.shape, np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(rest & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= count
            left = np.where(up, left - count, left)
            rest = np.where(up, rest >> np.uint64(width), rest)
            bit += np.where(up, width, 0)
        return np.where(known, word * 64 + bit, self.n_bits)
