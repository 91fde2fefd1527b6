"""Language-model scores by prediction by partial matching, and the unigram base beside them.

A text's tokens are its words (runs of anything but blank, tab and U+000A to U+000D), lower-cased in A-Z,
and one end. As bytes, blanks stand between words and a line feed for the end.

The pretrained trie holds byte contexts of up to ``ORDER`` bytes with the counts of the byte that
followed, gathered from all training documents. A byte is predicted in the longest context known; if
the context has not seen it, the model escapes (method D: half a count of every distinct byte seen goes to
the escape) to the next shorter context with the bytes of the longer one excluded, down to a uniform choice
among bytes never seen. Excluded counts depend on the context alone, so they are stored with it and the
code length of a byte is a table look-up.

The trie is whole: every run of the training documents counts, and no machine holds all of them. It is dealt
over ``SHARDS`` by the last two bytes of the context, so the contexts that a byte escapes through, down to
those two bytes, are in the shard of the longest; the two shorter orders, 65,792 entries at most, go to all
workers. Each block of documents sends its distinct byte runs to the shards once, to be counted, and once
more to be priced, and adds up its documents from the prices that come back. The base's words go the same
way, to shards of their own.

``code_length`` also runs a text adaptively, the model learning from each byte as it goes.

Null texts count as empty: one end. Rows with a null doc_id train the model. Repeated rows count as
often as they occur. Without training documents every byte has a probability of 1/256, and the base's
counts are 0. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

ORDER = 5
WIDTH = ORDER + 1
SHARDS = 256
#: Bytes of text in a block, whose distinct words and byte runs are held in memory at once.
BLOCK_BYTES = 12_000_000
#: Bytes of text whose words and byte runs are held one by one, repeated ones too, in many times that memory.
CHUNK_BYTES = 500_000
END = 10
_PAD = bytes([END]) * ORDER
END_HASH = xxhash.xxh64_intdigest(b"") - (1 << 64 if xxhash.xxh64_intdigest(b"") >> 63 else 0)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def runs(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The WIDTH bytes that end at every byte, as integers, and each stream's first position among them."""
    data = np.frombuffer(b"".join([_PAD + s for s in streams]), dtype=np.uint8).astype(np.uint64)
    grams = data[: len(data) - ORDER].copy()
    for k in range(1, WIDTH):
        grams <<= np.uint64(8)
        grams |= data[k : len(data) - ORDER + k]
    sizes = np.array([len(s) for s in streams])
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
    keep = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return grams[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def distinct_of(values: np.ndarray) -> np.ndarray:
    """Distinct values, rising; sorts the array in place, faster than the hashes of np.unique."""
    values.sort()
    return values[np.concatenate([np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]])]


class Counter:
    """Counts of integers, compacted as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, values: np.ndarray, counts: np.ndarray | None = None) -> None:
        part = np.unique(values, return_counts=True) if counts is None else (values, counts)
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > 1_000_000:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        values = np.concatenate([v for v, _ in self.parts])
        counts = np.concatenate([c for _, c in self.parts]).astype(np.int64)
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        out = (values[first], np.add.reduceat(counts, first)) if len(first) else (values, counts)
        self.parts, self.held = [out], len(out[0])
        return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: their texts, their distinct words and byte runs, with counts in training rows."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0

    class Block:
        def __init__(self):
            self.docs, self.body = [], []
            self.numbers: dict[bytes, int] = {}
            self.train = np.zeros(0, dtype=np.int64)
            self.ends = self.size = self.waiting = 0
            self.grams, self.streams, self.words = Counter(), ([], []), []

        def add(self, doc_id, text) -> None:
            words, train = tokens(text), not held_out(doc_id)
            number = self.numbers
            for w in words:
                if w not in number:
                    number[w] = len(number)
            self.docs.append(doc_id)
            self.body.append(stream(words))
            self.size += len(text or "")
            self.streams[train].append(self.body[-1])
            self.waiting += len(self.body[-1])
            if train:
                self.words.append(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)))
                self.ends += 1
            if self.waiting >= CHUNK_BYTES:
                self.flush()

        def flush(self) -> None:
            for train, streams in enumerate(self.streams):
                if streams:
                    grams, n = np.unique(runs(streams)[0], return_counts=True)
                    self.grams.add(grams, n * train)  # runs of held-out rows are to be priced, not counted
            self.train = np.bincount(np.concatenate([np.zeros(0, np.int64), *self.words]), minlength=len(self.numbers)) + np.pad(self.train, (0, len(self.numbers) - len(self.train)))
            self.streams, self.words, self.waiting = ([], []), [], 0

        def rows(self) -> Iterator[pa.RecordBatch]:
            self.flush()
            block = part << 32 | seq
            body = b"".join(self.body)
            yield _batch({"block": [block], "shard": [-1], "docs": [self.docs], "size": [len(body)], "body": [pa.compress(body, codec="zstd", asbytes=True)], "keys": [None], "counts": [None]}, _BLOCKS)
            words = Counter()
            words.add(word_hashes(self.numbers), np.append(self.train, self.ends))
            for keys, n, of in ((*self.grams.compact(), shard_of), (*words.compact(), word_shard)):
                cuts, order = dealt(of(keys))
                shards = sorted(cuts)
                none = [None] * len(shards)
                part_of = lambda x: [x[order[slice(*cuts[k])]] for k in shards]  # noqa: B023, E731
                yield _batch({"block": [block] * len(shards), "shard": shards, "docs": none, "size": none, "body": none, "keys": [pack(x, True) for x in part_of(keys)], "counts": [pack(x) for x in part_of(n)]}, _BLOCKS)

    block = Block()
    for batch in batches:
        for doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            block.add(doc_id, text)
            if block.size >= BLOCK_BYTES:
                yield from block.rows()
                block, seq = Block(), seq + 1
    if block.docs:
        yield from block.rows()


#: A block has one row of its documents, at shard -1, and for each shard one of its distinct byte runs or words.
_BLOCKS = "block long, shard int, docs array<long>, size long, body binary, keys binary, counts binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    types = dict(x.split(" ") for x in schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], _TYPES[t]) for k, t in types.items()], names=list(types))


def shard_of(grams: np.ndarray) -> np.ndarray:
    """The shard of runs, by the last two bytes of their contexts."""
    return ((((grams >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40_503) & np.uint64(0xFFFF)) * np.uint64(SHARDS) >> np.uint64(16)).astype(np.int64)


def word_shard(hashes: np.ndarray) -> np.ndarray:
    """The shard of words, beyond those of runs."""
    return SHARDS + (hashes % np.uint64(SHARDS)).astype(np.int64)


def word_hashes(words) -> np.ndarray:
    """Hashes of distinct words, and of the end."""
    return np.append(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)), np.int64(END_HASH).view(np.uint64))


def dealt(shards: np.ndarray) -> tuple[dict[int, tuple[int, int]], np.ndarray]:
    """(first and last place of each shard in the order, the order by shard) of keys in sorted order."""
    order = np.argsort(shards, kind="stable")
    some, first = np.unique(shards[order], return_index=True)
    return dict(zip(some.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True), strict=True)), order


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers of 64 bits, byte by byte of their places; rising ones by their steps."""
    own = np.ascontiguousarray(values).view(np.uint64)
    own = np.diff(own, prepend=np.uint64(0)) if rising else own
    planes = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(own).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b""
    own = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, n).T).view(np.uint64).reshape(n)
    return np.cumsum(own, dtype=np.uint64) if rising else own.view(np.int64)


def _returned(keys: np.ndarray, shards: np.ndarray, values: dict[int, bytes], read) -> np.ndarray:
    """Values of a block's sorted keys, from what each shard sent back in their order."""
    cuts, order = dealt(shards)
    out = np.zeros(len(keys), dtype=np.float64)
    for k, (a, b) in cuts.items():
        out[order[a:b]] = read(values[k])
    return out


def chunked(lines: list[bytes]) -> list[tuple[int, int]]:
    """First and last place of runs of lines of ``CHUNK_BYTES``; a longer line is one of its own."""
    ends = [0]
    while ends[-1] < len(lines):
        length, end = 0, ends[-1]
        while end < len(lines) and (length < CHUNK_BYTES or end == ends[-1]):
            length, end = length + len(lines[end]) + 1, end + 1
        ends.append(end)
    return list(zip(ends[:-1], ends[1:], strict=True))


def _finish(total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.log10(total + distinct + 1)
        for batch in batches:
            for docs, size, body, shards, sent in zip(*(batch.column(i) for i in range(5)), strict=True):
                values = dict(zip(shards.as_py(), sent.as_py(), strict=True))
                lines = pa.decompress(body.as_py(), decompressed_size=size.as_py(), codec="zstd", asbytes=True).split(b"\n")[:-1]
                spans = chunked(lines)
                number: dict[bytes, int] = {}
                words, n_words, found, held = [], [], [np.zeros(0, np.uint64)], 0
                for a, b in spans:  # words and runs of a chunk at a time; of the block, words by number and distinct runs
                    n_words.append(np.array([x.count(b" ") + 1 if x else 0 for x in lines[a:b]], dtype=np.int64))
                    own = b" ".join(lines[a:b]).split()
                    for w in dict.fromkeys(own):
                        if w not in number:
                            number[w] = len(number)
                    words.append(np.fromiter(map(number.__getitem__, own), dtype=np.int32, count=len(own)))
                    del own
                    found.append(distinct_of(runs([x + b"\n" for x in lines[a:b]])[0]))
                    held += len(found[-1])
                    if held > 1_000_000:
                        found = [distinct_of(np.concatenate(found))]
                        held = 0
                hashes = word_hashes(number)
                keys = np.unique(hashes)
                c = _returned(keys, word_shard(keys), values, unpack)[np.searchsorted(keys, hashes)]
                gain = np.log10(c + 1.0)
                grams = distinct_of(np.concatenate(found))
                del found
                table = Prices(grams, _returned(grams, shard_of(grams), values, lambda x: np.frombuffer(x, dtype=np.float32)))
                known_words, base, out = [], [], []
                for (a, b), word, n in zip(spans, words, n_words, strict=True):
                    doc = np.repeat(np.arange(b - a), n)
                    known_words.append(np.bincount(doc, c[word] > 0, b - a).astype(np.int64))
                    base.append(np.bincount(doc, gain[word], b - a) + gain[-1] - (n + 1) * scale)
                    own, starts = runs([x + b"\n" for x in lines[a:b]])
                    out.append(np.add.reduceat(table.find(own)[0], starts))
                n_words, known_words, base = (np.concatenate(x) for x in (n_words, known_words, base))
                ids = docs.as_py()
                yield _batch({"doc_id": ids, "held_out": [held_out(x) for x in ids], "n_tokens": n_words + 1, "n_known": known_words + int(c[-1] > 0), "base_score": base, "score": np.concatenate(out)}, _SCORES)

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class Prices:
    """Open-addressed table of the values of distinct byte runs."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << self.bits, dtype=np.float32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, one = np.unique(slot[left[free]], return_index=True)
            put = left[free][one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of runs, and the positions of those that the table lacks."""
        slot = self._slot(grams)
        out = self.values[slot].astype(np.float64)
        keys = self.keys[slot]
        none = keys == np.uint64(0xFFFFFFFFFFFFFFFF)
        unknown = [np.flatnonzero(none)]
        left = np.flatnonzero((keys != grams) & ~none)
        at = slot[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            keys = self.keys[at]
            hit = keys == grams[left]
            out[left[hit]] = self.values[at[hit]]
            none = keys == np.uint64(0xFFFFFFFFFFFFFFFF)
            unknown.append(left[none])
            go = ~hit & ~none
            left, at = left[go], at[go]
        return out, np.concatenate(unknown)


class Model:
    """The trie, as sorted tables of byte runs of each length with their counts."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        """tables[k]: (sorted runs of k + 1 bytes, counts)."""
        self.grams = [g.astype(np.uint64) for g, _ in tables]
        self.counts = [c.astype(np.float64) for _, c in tables]
        self.contexts, self.total, self.distinct, self.excluded = [], [], [], []
        for k, (g, c) in enumerate(zip(self.grams, self.counts, strict=True)):
            first = np.flatnonzero(np.concatenate([[True], (g[1:] >> np.uint64(8)) != (g[:-1] >> np.uint64(8))])) if len(g) else np.zeros(0, np.int64)
            add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)  # noqa: B023, E731
            self.contexts.append(g[first] >> np.uint64(8))
            self.total.append(add(c))
            self.distinct.append(add(np.ones(len(g))))
            if k:  # counts, in the next shorter context, of the bytes this context has seen
                short = self.counts[k - 1][np.searchsorted(self.grams[k - 1], g & np.uint64((1 << 8 * k) - 1))] if len(g) else np.zeros(0)
                self.excluded.append(add(short))
            else:
                self.excluded.append(np.zeros(len(first)))
        self.table: Prices | None = None

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each run after the bytes before it."""
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        gone = np.zeros(len(grams))  # counts and bytes excluded by the longer context
        gone_distinct = np.zeros(len(grams))
        for k in range(len(self.grams) - 1, -1, -1):
            if not len(open_):
                return out
            g = grams[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            context, known = self._find(self.contexts[k], g >> np.uint64(8))
            at, hit = self._find(self.grams[k], g)
            hit &= known
            total = np.where(known, self.total[k][context] if len(self.total[k]) else 0, 0) - gone[open_]
            fresh = np.where(known, self.distinct[k][context] if len(self.distinct[k]) else 0, 0) - gone_distinct[open_]
            some = known & (fresh > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = np.log10(((self.counts[k][at] if len(self.counts[k]) else np.zeros(len(at))) - 0.5) / total)
                escape = np.log10(fresh / (2 * total))
            out[open_[hit]] += seen[hit]
            left = ~hit
            out[open_[left & some]] += escape[left & some]
            gone[open_] = np.where(known, self.excluded[k][context] if len(self.excluded[k]) else 0, 0)
            gone_distinct[open_] = np.where(known, self.distinct[k][context] if len(self.distinct[k]) else 0, 0)
            open_ = open_[left]
        out[open_] -= np.log10(np.maximum(1, 256 - gone_distinct[open_]))
        return out

    def price(self, grams: np.ndarray) -> np.ndarray:
        """``log10`` through a table of the longest runs' values."""
        if self.table is None:
            self.table = Prices(self.grams[-1], self.log10(self.grams[-1]).astype(np.float32))
        out, rest = self.table.find(grams)
        if len(rest):
            own, back = np.unique(grams[rest], return_inverse=True)
            out[rest] = self.log10(own)[back]
        return out

    def scores(self, streams: list[bytes]) -> np.ndarray:
        """log10 probability of each stream."""
        if not streams:
            return np.zeros(0)
        grams, starts = runs(streams)
        return np.add.reduceat(self.price(grams), starts)


def code_length(data: bytes, order: int = ORDER) -> float:
    """Adaptive code length of a byte string in bits: the trie starts empty and learns each byte."""
    seen: dict[bytes, dict[int, int]] = {}
    bits = 0.0
    for i, symbol in enumerate(data):
        excluded: set[int] = set()
        for k in range(min(order, i), -1, -1):
            counts = seen.get(data[i - k : i])
            if not counts:
                continue
            open_ = {s: n for s, n in counts.items() if s not in excluded}
            if not open_:
                continue
            total = sum(open_.values())
            if symbol in open_:
                bits -= np.log2((open_[symbol] - 0.5) / total)
                break
            bits -= np.log2(len(open_) / (2 * total))
            excluded |= set(open_)
        else:
            bits += np.log2(256 - len(excluded))
        for k in range(min(order, i) + 1):
            own = seen.setdefault(data[i - k : i], {})
            own[symbol] = own.get(symbol, 0) + 1
    return float(bits)


def suffixes(grams: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The last bytes of runs, so many, with their counts."""
    held = Counter()
    held.add(grams & np.uint64((1 << 8 * length) - 1), counts)
    return held.compact()


_TRIE = "shard int, keys binary, counts binary, pairs array<long>, pair_counts array<long>, total long, distinct long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' runs and words, sorted by shard -> one row a shard, of those in training documents with their counts."""
    own, held = None, Counter()

    def row() -> pa.RecordBatch:
        keys, n = held.compact()
        pairs, m = suffixes(keys, n, 2) if own < SHARDS else (keys[:0], n[:0])
        return _batch({"shard": [own], "keys": [pack(keys, True)], "counts": [pack(n)], "pairs": [pairs.astype(np.int64)], "pair_counts": [m], "total": [int(n.sum())], "distinct": [len(n)]}, _TRIE)

    for batch in batches:
        for shard, keys, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if shard != own:
                if own is not None:
                    yield row()
                own, held = shard, Counter()
            values, counts = unpack(keys, True), unpack(n)
            if (counts > 0).any():
                held.add(values[counts > 0], counts[counts > 0])
    if own is not None:
        yield row()


def _price(short: list[tuple[np.ndarray, np.ndarray]]):
    """Rows sorted by shard, the shard's own first (block null) and then blocks' keys -> prices of runs, counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, values = None, None, None
        for batch in batches:
            blocks, shards, keys, counts = (batch.column(i).to_pylist() for i in range(4))
            at = 0
            while at < len(blocks):
                if blocks[at] is None:
                    known, n = unpack(keys[at], True), unpack(counts[at])
                    model, values = None, n
                    if shards[at] < SHARDS:
                        model = Model([*short, *(suffixes(known, n, k) for k in range(3, WIDTH + 1))])
                        values = model.log10(known).astype(np.float32)
                    at += 1
                    continue
                end = at
                while end < len(blocks) and blocks[end] is not None:
                    end += 1
                parts = [unpack(x, True) for x in keys[at:end]]
                own = np.concatenate(parts)
                out = np.zeros(len(own), dtype=values.dtype)
                place, hit = Model._find(known, own)
                out[hit] = values[place[hit]]
                if model is not None and not hit.all():
                    rest, back = np.unique(own[~hit], return_inverse=True)
                    out[~hit] = model.log10(rest)[back]
                sent = np.split(out, np.cumsum([len(x) for x in parts])[:-1])
                yield _batch({"block": blocks[at:end], "shard": shards[at:end], "sent": [pack(x) if model is None else x.tobytes() for x in sent]}, _PRICED)
                at = end

    return run


_PRICED = "block long, shard int, sent binary"


def price(blocks: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """(block, shard, sent): prices of every block's runs by the whole trie, and counts of its words; the training tokens, all and distinct."""
    own = blocks.where("shard >= 0")
    trie = own.select("shard", "keys", "counts").repartition("shard").sortWithinPartitions("shard").mapInArrow(_count, _TRIE)
    trie = scratch.cut(trie, "trie")
    pairs = trie.select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p")).groupBy(F.col("p.pairs").alias("gram")).agg(F.sum("p.pair_counts").alias("n"))
    rows = pairs.orderBy("gram").toArrow()  # two bytes: 65,536 rows at most
    grams, n = rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(np.int64)
    short = [suffixes(grams, n, 1), (grams, n)]
    total, distinct = trie.where(F.col("shard") >= SHARDS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    both = trie.select(F.lit(None).cast("long").alias("block"), "shard", "keys", "counts").unionByName(own.select("block", "shard", "keys", F.lit(None).cast("binary").alias("counts")))
    return both.repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first()).mapInArrow(_price(short), _PRICED), total, distinct


def score(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = scratch.cut(texts.mapInArrow(_gather, _BLOCKS), "blocks")
    prices, total, distinct = price(blocks, scratch)
    sent = prices.groupBy("block").agg(F.collect_list(F.struct("shard", "sent")).alias("p"))
    full = blocks.where("shard < 0").select("block", "docs", "size", "body").join(sent, "block").select("docs", "size", "body", F.col("p.shard").alias("shards"), F.col("p.sent").alias("sent"))
    scored = full.mapInArrow(_finish(total, distinct), _SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
