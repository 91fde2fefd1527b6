"""Token ids of a corpus as binary shards with Elias-Fano document boundaries.

A shard is one row of a Parquet table (Spark's commit protocol then covers lost executors, and any store
that Spark writes holds it). Its payload, little-endian:

    magic "LSTK", version u8, id width u8 (2 or 4 bytes), document count u64, id count u64
    Elias-Fano sequence of the documents' end offsets within the shard
    the concatenated ids

and its doc_ids are an Elias-Fano sequence of the distances from ``first_doc``, after ``null_docs`` rows
without one. Offsets and doc_ids are read by ``select`` in the bytes of the file; no table of them is built.
Shards follow each other in ascending doc_id order: (part, seq) sorts as the documents do, and ``before``
counts the ids of the part's earlier shards.

Nulls: a null text is the empty text and gets the end id alone. Rows with a null doc_id sort first and
come back with a null doc_id. Rows that share a doc_id are kept, each with its own ids, in any order among
themselves. Columns other than doc_id and text are not read. Strings of special tokens in a text are what
the library makes of them, special ids, unless ``special_as_text`` is set.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import eliasfano
from .scratch import new_path
from .wordtable import LONGEST, WordTable, buffer, slices

#: Documents end with this id.
END_ID = 0
#: A shard closes after so many ids, at the end of a slice of texts.
SHARD_IDS = 2_000_000
#: Bytes of text a partition should hold, by which the range partitions are counted.
PARTITION_BYTES = 24_000_000
#: Parts whose sizes are summed together.
GROUP = 1_000

_HEAD = struct.Struct("<4sBBQQ")
SHARD_SCHEMA = "part int, seq int, before long, n_ids long, null_docs long, first_doc long, doc_ids binary, payload binary"

#: Bytes of text that are looked up at once.
SLICE = 1_000_000
#: Words that are encoded as one text, whose ids are then told apart by the tokens that start with a blank.
TOGETHER = 2_000

# Kinds of bytes for the cuts below.
_BLANK, _SIGN, _ALNUM, _VISIBLE, _LEAD, _CONTINUES = 1, 2, 4, 8, 16, 32


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[list(b" \n")] |= _BLANK
    kinds[list(b".,;:!?*#%&$|@/()-")] |= _SIGN
    kinds[[c for c in range(128) if chr(c).isalnum()]] |= _ALNUM
    kinds[0x21:0x7F] |= _VISIBLE
    kinds[0xC3:0xCA] |= _LEAD  # of U+00C0 to U+027F, letters but for two signs
    kinds[0x80:0xC0] |= _CONTINUES
    return kinds


_KIND = _kinds()


def cuts(data: np.ndarray) -> np.ndarray:
    """Marks where a byte-level pre-tokenizer always starts a token, so that the parts encode apart to the same ids.

    These are a blank or line feed after a visible character, a sign after a letter or digit, and a letter or
    digit after such a sign (which an apostrophe is not).
    """
    cut = np.zeros(len(data), dtype=bool)
    if len(data) < 2:
        return cut
    kind = _KIND[data]
    wide = np.zeros(len(data), dtype=bool)
    wide[1:] = (kind[1:] & _CONTINUES > 0) & (kind[:-1] & _LEAD > 0)
    letter = wide.copy()
    letter[1:] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    before, now = kind[:-1], kind[1:]
    cut[1:] = (now & _BLANK > 0) & ((before & _VISIBLE > 0) | wide[:-1])
    cut[1:] |= (now & _SIGN > 0) & ((before & _ALNUM > 0) | letter[:-1])
    cut[1:] |= (now & _ALNUM > 0) & (before & _SIGN > 0)
    return cut


class Encoder:
    """The tokenizer, with a bounded memory of pieces already encoded."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        #: Texts with such a string are one piece.
        self.special = [] if special_as_text else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.blank[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.table = WordTable(self.learn, self.dtype)

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [x.decode("utf-8", "replace") for x in pieces]
        found: list = [None] * len(texts)
        plain = [k for k, x in enumerate(texts) if x[:1] == " " and x[1:].isalnum()]
        for at in range(0, len(plain), TOGETHER):
            part = plain[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join([texts[k] for k in part])], add_special_tokens=False)[0].ids, dtype=self.dtype)
            starts = np.flatnonzero(self.blank[ids]).tolist()
            if len(starts) == len(part):
                for k, a, b in zip(part, starts, [*starts[1:], len(ids)], strict=True):
                    found[k] = ids[a:b]
        rest = [k for k, own in enumerate(found) if own is None]
        for at in range(0, len(rest), TOGETHER):
            part = rest[at : at + TOGETHER]
            for k, own in zip(part, self.tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False), strict=True):
                found[k] = np.array(own.ids, dtype=self.dtype)
        return np.concatenate(found), np.array([len(x) for x in found]), np.zeros((len(found), 0))

    def column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts in a row, ends of each text's ids), for all texts in turn."""
        data, edges = buffer(texts)
        for a, b in slices(edges, SLICE):
            yield self._slice(data[edges[a] : edges[b]], edges[a : b + 1] - edges[a])

    def _slice(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = cuts(data)
        cut[edges[:-1][np.diff(edges) > 0]] = True
        starts = np.flatnonzero(cut)
        for special in self.special:
            raw = data.tobytes()
            if special in raw:
                own = [k for k in range(len(edges) - 1) if special in raw[edges[k] : edges[k + 1]]]
                inside = np.searchsorted(edges, starts, side="right") - 1
                starts = starts[~np.isin(inside, own) | np.isin(starts, edges)]
        sizes = np.diff(np.append(starts, len(data)))
        rows = self.table.find(np.concatenate([data, np.zeros(LONGEST, np.uint8)]), starts, sizes)
        ids, places = self.table.ids(rows)
        return ids, places[np.searchsorted(starts, edges[1:])]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [x for ids, ends in self.column(pa.array(texts, pa.string())) for x in np.split(ids, ends[:-1])]


@functools.lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    return Encoder(path, special_as_text)


def pack(ids: np.ndarray, ends: np.ndarray) -> bytes:
    return _HEAD.pack(b"LSTK", 1, ids.dtype.itemsize, len(ends), len(ids)) + eliasfano.encode(ends) + ids.tobytes()


class Shard:
    """One shard's bytes, read in place."""

    def __init__(self, data: bytes):
        magic, version, width, self.n_docs, self.n_ids = _HEAD.unpack_from(data, 0)
        if magic != b"LSTK" or version != 1:
            raise ValueError("not a token shard")
        self.ends = eliasfano.EliasFano(memoryview(data)[_HEAD.size :])
        self.ids = np.frombuffer(data, dtype=f"<u{width}", count=self.n_ids, offset=_HEAD.size + self.ends.size)

    def span(self, i: int) -> tuple[int, int]:
        """Where the i-th document's ids begin and end."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the shard."""
        start, end = self.span(i)
        return self.ids[start:end]


def _write_part(path: str, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before, coder = TaskContext.get().partitionId(), 0, 0, encoder(path, special_as_text)
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        n = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            named = [x for x in docs if x is not None]
            first = named[0] if named else 0
            # distances wrap around as unsigned 64-bit integers do, so they are right for any two doc_ids
            apart = np.array(named, dtype=np.int64).astype(np.uint64) - np.array([first], dtype=np.int64).astype(np.uint64)
            row = {"part": part, "seq": seq, "before": before, "n_ids": len(ids), "null_docs": len(docs) - len(named), "first_doc": first, "doc_ids": eliasfano.encode(apart), "payload": pack(ids, np.concatenate(ends))}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for ids, own in coder.column(batch.column(1)):
                docs += names[at : at + len(own)]
                at += len(own)
                held.append(np.insert(ids, own, np.array(END_ID, dtype=coder.dtype)))
                ends.append(n + own + np.arange(1, len(own) + 1))
                n += len(held[-1])
                if n >= SHARD_IDS:
                    yield close()
                    docs, held, ends, seq, before, n = [], [], [], seq + 1, before + n, 0
        if docs:
            yield close()

    return run


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("null_docs", pa.int64()), ("first_doc", pa.int64()), ("doc_ids", pa.binary()), ("payload", pa.binary())])


def write_shards(docs: DataFrame, tokenizer_path: str, out: str | None = None, special_as_text: bool = False) -> str:
    """Encode every text and write shards in ascending doc_id order; returns their folder."""
    spark = docs.sparkSession
    out = out or new_path(spark, "token-shards")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a part streams through its task shard by shard, so its size bounds no memory
    parts = max(1, -(-size // PARTITION_BYTES))
    (texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(_write_part(tokenizer_path, special_as_text), SHARD_SCHEMA).write.option("compression", "zstd").parquet(out))
    return out


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, before, nulls, first, names, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            shard, named = Shard(data), eliasfano.EliasFano(names)
            docs = [None] * nulls + [(first + x + (1 << 63)) % (1 << 64) - (1 << 63) for x in named]
            starts, sizes, crcs, start = [], [], [], 0
            for end in shard.ends:
                starts.append(before + start)
                sizes.append(end - start)
                crcs.append(zlib.crc32(shard.ids[start:end].astype("<u4")))
                start = end
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards alone.

    Starts within a part are in its shards; the ids of earlier parts are a running sum over groups of
    ``GROUP`` parts, then over the parts of a group, so no task holds a row for every part.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("group", F.floor(F.col("part") / GROUP))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = parts.groupBy("group").agg(F.sum("n").alias("n")).select("group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = parts.withColumn("inside", F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bases = inside.join(groups, "group").select("part", (F.col("base") + F.col("inside")).alias("base"))
    docs = shards.select("part", "before", "null_docs", "first_doc", "doc_ids", "payload").mapInArrow(_read_docs, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(bases, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
