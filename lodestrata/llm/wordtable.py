"""Words of a text stream looked up many at a time in a table of what is known of them.

Words are byte ranges of one buffer. Up to ``LONGEST`` bytes, a word and its length are four machine words, so
comparing them is exact; the table is open-addressed and every step of a lookup works on all words at once.
Longer words, which are rare, go through a dictionary. What is known of a word is a run of ids and a few
numbers. A table that holds ``most`` words is emptied before the next lookup, so its memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

LONGEST = 24
MOST = 300_000
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x165667B19E3779F9))


class WordTable:
    """``learn(words)`` gives the ids of all words in a row, how many belong to each, and the words' numbers."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], dtype, numbers: int = 0, most: int = MOST):
        self.learn, self.dtype, self.numbers, self.most = learn, np.dtype(dtype), numbers, most
        self.bits = max(20, (2 * most).bit_length())
        self.generation = 0
        self.clear()

    def clear(self) -> None:
        self.generation += 1
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.n, self.used = 0, 0
        self.keys = np.zeros((1024, 4), dtype=np.uint64)
        self.first = np.zeros(1024, dtype=np.int64)
        self.count = np.zeros(1024, dtype=np.int64)
        self.values = np.zeros((1024, self.numbers))
        self.pool = np.zeros(4096, dtype=self.dtype)
        self.long: dict[bytes, int] = {}

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows of the words; ``data`` ends with LONGEST bytes that belong to none. Rows hold until the next call."""
        if self.n > self.most:
            self.clear()
        view = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
        keys = np.empty((len(starts), 4), dtype=np.uint64)
        for k in range(3):
            keys[:, k] = view[starts + 8 * k * (sizes > 8 * k)] & _MASK[np.clip(sizes - 8 * k, 0, 8)]
        keys[:, 3] = sizes
        hashes = np.zeros(len(starts), dtype=np.uint64)
        for k in range(4):
            hashes = (hashes ^ (hashes >> np.uint64(29)) ^ keys[:, k]) * _ODD[k]
        hashes ^= hashes >> np.uint64(32)
        rows = np.full(len(starts), -1, dtype=np.int64)
        left = np.flatnonzero(sizes <= LONGEST)
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at = slots[left]
        missing = []
        while len(left):
            held = self.slots[at]
            empty = held < 0
            same = (self.keys[held] == keys[left]).all(axis=1) & ~empty
            rows[left[same]] = held[same]
            missing.append(left[empty])
            on = ~(same | empty)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        new = np.concatenate([np.zeros(0, np.int64), *missing])
        raw = None
        if len(new):
            raw = data.tobytes()
            _, one, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            words = [raw[s : s + n] for s, n in zip(starts[one].tolist(), sizes[one].tolist(), strict=True)]
            own = self._add(words, keys[one])
            equal = (keys[new] == keys[one[back]]).all(axis=1)  # not so if two words share a hash
            rows[new[equal]] = own[back[equal]]
            self._place(own, slots[one])
        rest = np.flatnonzero(rows < 0)
        if len(rest):
            raw = raw or data.tobytes()
            words = [raw[s : s + n] for s, n in zip(starts[rest].tolist(), sizes[rest].tolist(), strict=True)]
            unknown = list(dict.fromkeys(w for w in words if w not in self.long))
            self.long.update(zip(unknown, self._add(unknown, np.zeros((len(unknown), 4), np.uint64)).tolist(), strict=True))
            rows[rest] = [self.long[w] for w in words]
        return rows

    def _add(self, words: list[bytes], keys: np.ndarray) -> np.ndarray:
        if not words:
            return np.zeros(0, dtype=np.int64)
        ids, counts, numbers = self.learn(words)
        n, used = self.n + len(words), self.used + len(ids)
        for name in ("keys", "first", "count", "values"):
            setattr(self, name, _grown(getattr(self, name), self.n, n))
        self.pool = _grown(self.pool, self.used, used)
        rows = slice(self.n, n)
        self.keys[rows], self.count[rows], self.values[rows] = keys, counts, numbers
        self.first[rows] = self.used + np.cumsum(counts) - counts
        self.pool[self.used : used] = ids
        self.n, self.used = n, used
        return np.arange(rows.start, n)

    def _place(self, rows: np.ndarray, at: np.ndarray) -> None:
        at = at.copy()
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]
            left = self.slots[at] != rows
            rows, at = rows[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in a row, and where each row's begin (with the end of all)."""
        counts = self.count[rows]
        edges = np.concatenate([[0], np.cumsum(counts)])
        return self.pool[np.repeat(self.first[rows] - edges[:-1], counts) + np.arange(edges[-1])], edges


def _grown(values: np.ndarray, used: int, wanted: int) -> np.ndarray:
    if wanted <= len(values):
        return values
    out = np.zeros((max(wanted, 2 * len(values)), *values.shape[1:]), dtype=values.dtype)
    out[:used] = values[:used]
    return out


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, edges, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if edges is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    edges = np.frombuffer(edges, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def slices(edges: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, one text at least each."""
    out, at = [], 0
    while at < len(edges) - 1:
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + size, side="right")) - 1)
        out.append((at, end))
        at = end
    return out
