"""Quality scores from zstandard dictionaries.

Two dictionaries are built, from good and from bad labelled texts. A text that resembles the good ones
shrinks more with the good dictionary, so the normalised difference of its two compressed sizes is a
score, which a logistic curve fitted on other labelled texts turns into a probability of label 1.

The whole text counts: it is compressed in blocks, so that a long text cannot teach the compressor its
own habits and hide the dictionary's effect.

Nulls and empty texts get the labelled texts' base rate. Null labels, labels of missing documents and
labels with a null doc_id teach nothing. A doc_id labelled both ways teaches both. With labels of one
class only, or none, every text gets the smoothed base rate. Ties and repeated rows are scored alike, and so are
rows with a null doc_id, whose ``held_out`` is null; columns other than those named are kept as they are, but the
score replaces a column of its name.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import lean

#: Labelled rows taken for each class at most, by hash of doc_id, and the longest text among them.
SAMPLE_PER_CLASS = 2_000
SAMPLE_MAX_CHARS = 60_000
#: Share of the sample that builds dictionaries; the rest calibrates.
DICTIONARY_SHARE = 0.6
DICTIONARY_BYTES = 64 * 1024
BLOCK_BYTES = 2_048
LEVEL = 3


@dataclasses.dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    intercept: float
    base: float


def held_out(doc_id="doc_id"):
    """The rows that no label is learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE_PER_CLASS):
    """(texts, labels, counts by class): a bounded sample of labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    # at most two classes' samples: a bounded side
    rows = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_MAX_CHARS))
        .join(F.broadcast(ids.dropDuplicates(["doc_id", "y"])), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(2 * per_class)
        .toPandas()
    )
    return rows["text"].tolist(), rows["y"].to_numpy(dtype=int), counts


def _blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


class Compressors:
    def __init__(self, model: Model):
        import zstandard as zs

        def make(raw: bytes):
            data = zs.ZstdCompressionDict(raw)
            data.precompute_compress(level=LEVEL)
            return zs.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)

        self.model, self.good, self.bad = model, make(model.good), make(model.bad)

    def features(self, text: str) -> list[float]:
        """(bad - good) / (bad + good) of the compressed sizes, and how far the text shrinks at all: the
        logarithms of compressed to plain size over the text and in the block that shrinks most. The
        last two tell repetition, which either dictionary hides, from prose.
        """
        good = bad = plain = 0
        least = 0.0
        for block in _blocks(text):
            g, b = len(self.good.compress(block)), len(self.bad.compress(block))
            good, bad, plain = good + g, bad + b, plain + len(block)
            least = min(least, math.log(min(g, b) / len(block)))
        return [(bad - good) / (bad + good), math.log(min(good, bad) / plain), least] if plain else [0.0, 0.0, 0.0]

    def score(self, text: str | None) -> float:
        if not text or not text.strip() or not self.model.good:
            return self.model.base
        z = sum(w * x for w, x in zip(self.model.weights, self.features(text), strict=True)) + self.model.intercept
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], float]:
    """Weights and intercept by Newton steps with a small ridge, on standardised columns."""
    mean, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), gradient)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    own = w[:-1] / spread
    return own.tolist(), float(w[-1] - own @ mean)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """The model; it is learnt from a sample of bounded size, on the driver."""
    import zstandard as zs

    texts, y, counts = sample(docs, labels, label, per_class)
    base = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", [], 0.0, base)
    build = np.zeros(len(y), dtype=bool)
    for k in (0, 1):
        own = np.flatnonzero(y == k)
        build[own[: max(1, int(len(own) * DICTIONARY_SHARE))]] = True

    def dictionary(k: int) -> bytes:
        blocks = [b for i in np.flatnonzero(build & (y == k)) for b in _blocks(texts[i])]
        try:
            return zs.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
        except zs.ZstdError:  # too few blocks to train on: their bytes serve as they are
            return b"".join(blocks)[-DICTIONARY_BYTES:] or b"\0"

    model = Model(dictionary(1), dictionary(0), [1.0, 0.0, 0.0], 0.0, base)
    rest = np.flatnonzero(~build)
    if len(set(y[rest].tolist())) < 2:
        rest = np.arange(len(y))
    tools = Compressors(model)
    x = np.array([tools.features(texts[i]) for i in rest])
    own = y[rest]
    # the sample takes as many of either class as it can; weights restore the labels' shares
    weight = np.where(own == 1, base / max(1, (own == 1).sum()), (1 - base) / max(1, (own == 0).sum())) * len(own)
    model.weights, model.intercept = _logistic(x, own.astype(float), weight)
    return model


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tools = Compressors(shared.value) if shared.value.good else None
        for texts in batches:
            yield pd.Series([shared.value.base if tools is None else tools.score(x) for x in texts], dtype="float64")

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(scored)(batches)

    return docs.withColumn(column, probability(F.col("text")))
