"""Passages that occur in an earlier document, cut from later ones.

A window is ``WINDOW`` consecutive words of one document. It is a repeat if its words also start in a
document with a smaller doc_id. Every word that a repeat covers goes.

1. Phrases: of every run of WINDOW words the smallest hash among its ``PHRASE``-word runs is kept
   (winnowing), so two equal windows hold the same kept phrase. Only hashes travel. A phrase kept in several
   documents is confirmed: its words are read from the document with the smallest doc_id.
2. Automata: documents are dealt over blocks, which are the shards. A block's confirmed phrases are compiled
   into one Aho-Corasick automaton with pyahocorasick, and all documents of the block stream through it. That
   alone says where confirmed phrases occur, and the windows around occurrences are all that can recur. A block's
   automaton is bounded by its text, and every document is read once, however many phrases there are.
3. Windows: the smallest doc_id of each is an aggregate with map-side combine over 96-bit hashes; the
   join back is one that Spark splits where a passage is in very many documents.

Documents whose words are those of a smaller doc_id are removed whole at the start (if they have WINDOW
words or more) and need no windows.

Null and empty texts have no words. Fewer than WINDOW words are never removed. Rows with a null doc_id
are kept whole and are nobody's source. Rows that share a doc_id do not repeat each other. Repeated
rows get equal results. Nothing is returned for an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import salted
from .scratch import Scratch, apart
from .shingles import WORD_HASHES, long_grams, split_words, winnow
from .workers import lean

WINDOW = 50
PHRASE = 25
#: Bytes of text in a block, which bounds its automaton.
BLOCK_BYTES = 4_000_000
#: Bytes of text in a partition that streams blocks.
PARTITION_BYTES = 64_000_000
#: Bytes of a batch whose texts are held as Python objects at once.
SLICE_BYTES = 2_000_000
_OTHER = np.uint64(0x5851F42D4C957F2D)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, in slices of about ``SLICE_BYTES``."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _read(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n, sha, grams, at = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = split_words(text)
                n.append(len(words))
                sha.append(_digest(words))
                if len(words) < window:
                    grams.append([])
                    at.append([])
                    continue
                own = long_grams(WORD_HASHES.of(words), phrase)
                kept = winnow(own, window - phrase + 1)
                grams.append(own[kept].astype(np.int64))
                at.append(kept.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(grams, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "tkey", "n_words", "sha", "grams", "at"])

    return run


def _confirm(phrase: int):
    """(text, [(at, gram)]) -> the words of every gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            grams, phrases = [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split_words(text)
                for own in wanted:
                    grams.append(own["gram"])
                    phrases.append(b" ".join(words[own["at"] : own["at"] + phrase]))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(phrases, pa.binary())], names=["gram", "phrase"])

    return run


class Phrases:
    """Aho-Corasick automaton over phrases given as word runs."""

    def __init__(self, phrases: list[bytes]):
        import ahocorasick

        self.vocabulary: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        put = self.vocabulary.setdefault
        for phrase in phrases:
            own = tuple([put(w, len(self.vocabulary) + 1) for w in phrase.split()])
            self.automaton.add_word(own, len(own))
        self.automaton.make_automaton()

    def occurrences(self, words: list[bytes]) -> np.ndarray:
        """Start of every phrase in a document, in order of their ends."""
        if not self.vocabulary:
            return np.zeros(0, dtype=np.int64)
        get = self.vocabulary.get
        numbers = tuple([get(w, 0) for w in words])  # 0 is in no phrase
        return np.array([end - size + 1 for end, size in self.automaton.iter(numbers)], dtype=np.int64)


def candidate_windows(n: int, starts: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Starts of the windows of n words that hold a phrase at one of ``starts``."""
    last = n - window
    edge = np.zeros(n + 2, dtype=np.int64)
    np.add.at(edge, np.clip(starts - (window - phrase), 0, None), 1)
    np.add.at(edge, np.minimum(starts, last) + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: last + 1] > 0)


def _locate(window: int, phrase: int):
    """Rows sorted by block and kind -> documents with windows that can recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, phrases, copies, found = None, [], set(), None
        for batch in _slices(batches):
            out: dict = {k: [] for k in ("doc_id", "tkey", "text", "starts", "h1", "h2")}
            for own, kind, words, doc_id, tkey, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if own != block:
                    block, phrases, copies, found = own, [], set(), None
                if kind == 0:
                    phrases.append(words)
                    continue
                if kind == 1 or (doc_id, tkey) in copies:
                    copies.add((doc_id, tkey))
                    continue
                if found is None:
                    found = Phrases(phrases)
                words = split_words(text)
                if len(words) < window or not len(at := found.occurrences(words)):
                    continue
                starts = candidate_windows(len(words), at, window, phrase)
                hashes = WORD_HASHES.of(words)
                for k, v in zip(out, (doc_id, tkey, text, starts.astype(np.int32), long_grams(hashes, window)[starts].astype(np.int64), (long_grams(hashes * _OTHER + np.uint64(1), window)[starts] >> np.uint64(33)).astype(np.int32)), strict=True):
                    out[k].append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n, sha, spans = [], [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = split_words(text)
                gone = covered(len(words), starts, window)
                n.append(int(gone.sum()))
                sha.append(_digest([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append(edge.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(spans, pa.list_(pa.int32()))], names=["doc_id", "tkey", "n_removed", "kept_sha", "spans"])

    return run


def covered(n: int, starts: list[int], window: int) -> np.ndarray:
    """Which of n words the windows at ``starts`` cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.asarray(starts, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:n] > 0


def find(docs: DataFrame, scratch: Scratch, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, tkey (hash of the text), n_words, n_removed, kept_sha256, spans of every row.

    ``spans`` holds the word positions where removed stretches begin and end, in turn.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")
    read = scratch.cut(texts.mapInArrow(lean(_read(window, phrase)), "doc_id long, tkey long, n_words long, sha binary, grams array<long>, at array<int>"), "words")
    copies = read.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first")
    read_first = scratch.cut(salted(read, scratch.cut(copies, "copies"), "sha", "doc_id").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))), "placed-words")
    scratch.drop("words")
    scratch.drop("copies")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "tkey"), F.lit(blocks))
    sources = read_first.where("NOT copy AND doc_id IS NOT NULL AND size(grams) > 0").select("doc_id", "tkey", "grams", "at")
    phrases = sources.select("doc_id", "tkey", F.explode(F.arrays_zip("grams", "at")).alias("p")).select("doc_id", "tkey", F.col("p.grams").alias("gram"), F.col("p.at").alias("at"))
    recurring = scratch.cut(phrases.groupBy("gram").agg(F.min(F.struct("doc_id", "tkey", "at")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last").select("gram", "first.*"), "recurring")
    places = recurring.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("at", "gram")).alias("places"))
    # rows that share a text confirm its phrases again, and short phrases are cheaper to make distinct than texts
    said = texts.join(places, ["doc_id", "tkey"]).select("text", "places").mapInArrow(lean(_confirm(phrase)), "gram long, phrase binary")
    confirmed = scratch.cut(said.groupBy("gram").agg(F.first("phrase").alias("phrase")), "confirmed")
    scratch.drop("recurring")
    wanted = phrases.select(block.alias("block"), "gram").distinct().join(confirmed, "gram")

    # in a block come first its phrases, then the copies, which need no windows, then its texts
    none = F.lit(None)
    rows = wanted.select("block", F.lit(0).alias("kind"), "phrase", none.cast("long").alias("doc_id"), none.cast("long").alias("tkey"), none.cast("string").alias("text"))
    rows = rows.unionByName(read_first.where("copy").select(block.alias("block"), F.lit(1).alias("kind"), none.cast("binary").alias("phrase"), "doc_id", "tkey", none.cast("string").alias("text")))
    rows = rows.unionByName(texts.where("doc_id IS NOT NULL AND text IS NOT NULL").select(block.alias("block"), F.lit(2).alias("kind"), none.cast("binary").alias("phrase"), "doc_id", "tkey", "text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    stream = rows.repartition(parts, "block").sortWithinPartitions("block", "kind")
    located = scratch.cut(stream.mapInArrow(lean(_locate(window, phrase)), "doc_id long, tkey long, text string, starts array<int>, h1 array<long>, h2 array<int>"), "windows")
    scratch.drop("confirmed")
    windows = located.select("doc_id", "tkey", F.explode(F.arrays_zip("starts", "h1", "h2")).alias("w")).select("doc_id", "tkey", F.col("w.starts").alias("start"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    firsts = scratch.cut(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first"), "firsts")
    gone = windows.join(firsts, ["h1", "h2"]).where("first < doc_id").groupBy("doc_id", "tkey").agg(F.collect_set("start").alias("starts"))
    cut = located.select("doc_id", "tkey", "text").join(gone, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "starts").mapInArrow(lean(_cut(window)), "doc_id long, tkey long, n_removed long, kept_sha binary, spans array<int>")
    cut = scratch.cut(cut.groupBy("doc_id", "tkey").agg(F.first("n_removed").alias("n_removed"), F.first("kept_sha").alias("kept_sha"), F.first("spans").alias("spans")), "cut")

    whole = F.col("copy") & (F.col("n_words") >= window)
    out = read_first.select("doc_id", "tkey", "n_words", "sha", "copy").join(cut, ["doc_id", "tkey"], "left")
    return out.select(
        "doc_id",
        "tkey",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
        F.when(whole, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.coalesce("spans", F.array().cast("array<int>"))).alias("spans"),
    )


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of columns with a text and, last, the spans to cut from it."""
    for batch in _slices(batches):
        at = batch.schema.get_field_index("text")
        out = []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            out.append(text if not text or not spans else without(text, spans))
        yield batch.set_column(at, "text", pa.array(out, pa.string()))


def without(text: str, spans: list[int]) -> str:
    """The text with removed word stretches, and the white space after them, cut out."""
    data = text.encode("utf-8", "surrogatepass")
    edges = _word_edges(data)
    keep, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        keep.append(data[at : edges[a]])
        at = edges[b] if b < len(edges) else len(data)
    return b"".join([*keep, data[at:]]).decode("utf-8", "surrogatepass")


def _word_edges(data: bytes) -> np.ndarray:
    """Byte offsets at which words begin."""
    raw = np.frombuffer(data, dtype=np.uint8)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    return np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))


def remove_repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``docs`` with repeated passages cut from text; rows and other columns stay."""
    own = apart(docs.columns)
    found = find(docs, scratch, window, phrase).where(F.size("spans") > 0)
    spans = found.select(F.col("doc_id").alias(f"{own}doc"), F.col("tkey").alias(f"{own}tkey"), F.col("spans").alias(f"{own}spans")).dropDuplicates([f"{own}doc", f"{own}tkey"])
    same = (F.col("doc_id") == F.col(f"{own}doc")) & (F.xxhash64("text") == F.col(f"{own}tkey"))
    joined = docs.join(spans, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], f"{own}spans")
    return joined.mapInArrow(lean(_strip), joined.schema).drop(f"{own}spans")
