"""Word shingles as sets of 64-bit hashes, and MinHash signatures of them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hash a worker remembers.
MEMO = 400_000
#: Values of a signature.
SIGNATURE = 96
_SEED = 20_240_214


def split_words(text: str | None) -> list[bytes]:
    """Words of a text: runs of anything but blank, tab and U+000A to U+000D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, computed once while the memory lasts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


WORD_HASHES = WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order; none if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        acc = mix((acc ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
    return acc


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, lower-cased in A-Z; fewer words make one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(grams(WORD_HASHES.of(words), min(size, len(words))))


_RNG = np.random.default_rng(_SEED)
_A = (_RNG.integers(0, 1 << 31, SIGNATURE, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 1 << 32, SIGNATURE, dtype=np.uint64).astype(np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """SIGNATURE smallest values of the set under as many orders."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(SIGNATURE, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, x.shape[1], 4096):
        np.minimum(out, (x[:, at : at + 4096] * _A + _B).min(axis=1), out=out)
    return out


_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def long_grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; runs of 1, 2, 4 ... words are joined, so it takes log2(size) steps."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, step, acc, done = hashes, 1, None, 0
    while True:
        if size & step:
            part = power[done : done + n]
            acc = part if acc is None else mix(acc * _C1 + part * _C2 + np.uint64(step))
            done += step
        step *= 2
        if step > size:
            return acc
        power = mix(power[: len(power) - step // 2] * _C1 + power[step // 2 :] * _C2)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    n = len(values) - width + 1
    step = 1
    while step * 2 <= width:
        values = pick(values[: len(values) - step], values[step:])
        step *= 2
    return pick(values[:n], values[width - step : width - step + n])


def winnow(grams_: np.ndarray, width: int) -> np.ndarray:
    """Positions of grams that are the smallest of some ``width`` grams in a row."""
    if len(grams_) < width:
        return np.zeros(0, dtype=np.int64)
    least = _sliding(grams_, width, np.minimum)
    pad = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero(grams_ == _sliding(np.concatenate([pad, least, pad]), width, np.maximum))
