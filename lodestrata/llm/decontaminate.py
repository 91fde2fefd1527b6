"""Benchmark windows found in documents with one Aho-Corasick automaton.

Texts are normalised to words: A-Z is lower-cased, and a word is a run of digits, a-z and characters
outside ASCII. Every window of ``WINDOW`` consecutive words of a test item (an item with fewer words
is one window) goes into one automaton over word numbers. Each document runs through it once; matches
are word positions, which map back to character offsets of the original text.

The automaton is built in every worker from a broadcast list of test texts of checked size. A byte of their
text costs about 60 bytes of automaton, so one automaton takes ``AUTOMATON_BYTES`` of it; the items of a larger
table are dealt into several, each of which scans the documents in turn.

Null or empty texts have no words and no hits. Items without words, or with a null id or text, have no
windows. Rows that repeat an item, or a window that several items share, count for each distinct item
id. Repeated documents give repeated rows. An empty table on either side gives no hits, or no rows.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, apart
from .workers import lean

WINDOW = 10
#: Benchmark text of one automaton, which is some 120 MB in every worker.
AUTOMATON_BYTES = 2_000_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    """Normalised words."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def offsets(text: str) -> list[tuple[int, int]]:
    """Character span of each word in the original text."""
    return [m.span() for m in _WORD.finditer(text)]


class Windows:
    """The automaton and what its windows belong to."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        import ahocorasick

        self.vocabulary: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        #: Words of a window, and the items that have it, by the window's number.
        self.sizes = array("B") if window < 256 else array("L")
        self.owners: list = []
        for item, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(own) - window + 1)) if own else ():
                key = tuple(own[i : i + window])
                k = self.automaton.get(key, -1)
                if k < 0:
                    self.automaton.add_word(key, len(self.owners))
                    self.sizes.append(len(key))
                    self.owners.append(item)
                elif isinstance(self.owners[k], set):
                    self.owners[k].add(item)
                elif self.owners[k] != item:
                    self.owners[k] = {self.owners[k], item}
        self.empty = not self.owners
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, own: list[bytes]) -> tuple[list[list[int]], set]:
        """([first, past-the-last] word of every stretch that windows hit, items with an occurring window)."""
        spans: list[list[int]] = []
        items: set = set()
        if self.empty or not own:
            return spans, items
        known = self.vocabulary.get
        for end, k in self.automaton.iter(tuple([known(w, 0) for w in own])):
            first, who = end - self.sizes[k] + 1, self.owners[k]
            while spans and spans[-1][0] >= first:
                spans.pop()
            if spans and spans[-1][1] >= first:
                spans[-1][1] = end + 1
            else:
                spans.append([first, end + 1])
            items |= who if isinstance(who, set) else {who}
        return spans, items


_BUILT: dict[str, Windows] = {}


def _windows(name: str, shared, window: int) -> Windows:
    """The automaton of a broadcast list, built once in a worker."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows(shared.value, window)
    return _BUILT[name]


def _scan(shared, window: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _windows(name, shared, window)
        for batch in batches:
            out = {k: [] for k in ("n_words", "spans", "items")}
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                own = words(text)
                spans, items = found.scan(own)
                at = offsets(text) if spans else []
                out["n_words"].append(len(own))
                out["spans"].append([{"first_word": a, "end_word": b, "start": at[a][0], "end": at[b - 1][1]} for a, b in spans])
                out["items"].append(sorted(items))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out["n_words"], pa.int64()), pa.array(out["spans"], _SPANS), pa.array(out["items"], pa.list_(pa.string()))], names=[*batch.schema.names, "n_words", "hit_spans", "hit_items"])

    return run


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_ADDED = "n_words long, hit_spans array<struct<first_word: long, end_word: long, start: long, end: long>>, hit_items array<string>"


def _merge_spans(spans):
    """Stretches sorted and joined where they touch or overlap, in column functions."""
    return F.aggregate(
        F.array_sort(spans),
        F.slice(spans, 1, 0),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end_word"] >= x["first_word"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first_word"].alias("first_word"), F.greatest(F.element_at(acc, -1)["end_word"], x["end_word"]).alias("end_word"), F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` (with a column text) plus n_words, hit_spans and hit_items (ids as strings), which replace columns so named."""
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // automaton_bytes))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def one(part: DataFrame, to: DataFrame, named: str) -> DataFrame:
        rows = [(r["item_id"], r["text"]) for r in part.collect()]  # of checked size
        return to.mapInArrow(lean(_scan(spark.sparkContext.broadcast(rows), window)), f"{named}, {_ADDED}")

    if shards == 1:
        return one(items, docs, schema)
    scratch = scratch or Scratch(spark)
    row = f"{apart(docs.columns)}row"
    numbered = scratch.cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-docs")
    found = None
    for k in range(shards):
        part = one(items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k), numbered.select(row, "text"), f"{row} long, text string").drop("text")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy(row).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))
    return numbered.join(merged.withColumn("hit_spans", _merge_spans(F.col("hit_spans"))), row).drop(row)


def n_hit():
    """Hit words of a row of ``find``."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end_word"] - x["first_word"])


def remove_hits(found: DataFrame) -> DataFrame:
    """``find``'s rows with the hit stretches cut out of text, by their original offsets."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [_without(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column("hit_spans").to_pylist(), strict=True)]
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return found.mapInArrow(cut, found.schema)


def _without(text: str | None, spans: list[dict] | None) -> str | None:
    if not text or not spans:
        return text
    keep, at = [], 0
    for x in spans:
        keep.append(text[at : x["start"]])
        at = x["end"]
    return "".join([*keep, text[at:]])
