"""Near-duplicate vectors by random-hyperplane signs, exact cosines and connected components.

Equal vectors form one class. A class stands in a bucket of each of several tables: the signs of its
products with ``bits`` random hyperplanes. Within a bucket cosines are exact, in double precision. A
large bucket is cut into blocks and every pair of blocks is a task's work, so no bucket, however
popular, meets in one task and no pair of vectors is ever a row: tasks return a count for each vector,
and the links of a spanning forest. A pair that meets in several tables counts in the first of them.

Bits grow with the number of classes, and tables with the bits, so that a pair at the threshold misses
every table with probability ``MISS`` at most.

Vectors that are null, of zero length, or hold a null or non-finite component link with nothing, and
neither do vectors of different dimension. An empty table gives no rows. Rows with a null vec_id get
one link class each, their own; repeated (vec_id, vector) rows count as vectors of their own.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import SALT, components
from .scratch import Scratch
from .workers import lean

THRESHOLD = 0.95
MISS = 1e-6
#: Classes a bucket should hold, by which bits are chosen.
BUCKET = 128
#: Rows of a block; a task compares two blocks.
BLOCK = 1_024
SEED = 20_240_117


def plan(classes: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) for so many classes."""
    bits = int(min(24, max(4, round(math.log2(max(classes, 1) / BUCKET + 1)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


@functools.lru_cache(maxsize=8)
def _hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.rint(np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables)) * 1_024)


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of ``dim`` doubles, from bytes of doubles or of floats."""
    return np.vstack([np.frombuffer(x, dtype="<f4" if len(x) == 4 * dim else "<f8").astype(np.float64) for x in column])


def _thin(m: np.ndarray) -> list[bytes]:
    """Each row's bytes, as floats where these are the same numbers."""
    with np.errstate(over="ignore"):
        short = m.astype("<f4")
    return [(a if same else b).tobytes() for a, b, same in zip(short, m, (short == m).all(axis=1).tolist(), strict=True)]


def _codes(unit: np.ndarray, bits: int, tables: int, only: int | None = None) -> np.ndarray:
    """Codes of the first ``only`` tables. Both factors are whole numbers, so a vector has the same signs in any company."""
    only = tables if only is None else only
    whole = np.rint(unit * (1 << 20))
    signs = (whole @ _hyperplanes(unit.shape[1], bits, tables)[:, : only * bits] >= 0).reshape(len(unit), only, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).astype("<i4")


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each usable vector as bytes of doubles; -0.0 becomes 0.0 so that equal vectors have equal bytes."""
    for batch in batches:
        ids, raw = [], []
        for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = None
            if x and None not in x:
                v = np.array(x, dtype="<f8") + 0.0
                if np.isfinite(v).all() and (v != 0).any():
                    own = v.tobytes()
            ids.append(name)
            raw.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "raw"])


def _hash(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(2).to_pylist()
            sizes = np.array([len(x) for x in raw])
            out: list = [None] * len(raw)
            thin: list = [None] * len(raw)
            for size in np.unique(sizes):
                at, dim = np.flatnonzero(sizes == size), int(size // 8)
                m = _matrix([raw[i] for i in at], dim)
                scale = np.abs(m).max(axis=1, keepdims=True)
                for i, code, own in zip(at, _codes(m / scale, bits, tables), _thin(m), strict=True):
                    out[i] = [(dim << 32) | int(c) for c in code]
                    thin[i] = own
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(thin, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["cls", "members", "thin", "codes"])

    return run


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m, np.sqrt((m * m).sum(axis=1))


def _compare(threshold: float, bits: int, tables: int):
    """Counts and spanning links among two blocks of one bucket (or within one)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table, code, i, j = key
        ids, own = pdf["cls"].to_numpy(), pdf["blk"].to_numpy()
        counts = pdf["members"].to_numpy()
        m, norm = _unit(_matrix(pdf["thin"], int(code) >> 32))
        codes = _codes(m, bits, tables, int(table)) if table else None
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = np.zeros(len(ids), dtype=np.int64)
        links: list[tuple[int, int]] = []
        parent = list(range(len(ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            cos = (m[rows] @ m[right].T) / (norm[rows][:, None] * norm[right][None, :])
            hit = cos >= threshold
            if i == j:
                hit &= right[None, :] > rows[:, None]
            x, y = np.nonzero(hit)
            x, y = rows[x], right[y]
            if table and len(x):
                fresh = np.ones(len(x), dtype=bool)
                for k in range(0, len(x), 65_536):
                    fresh[k : k + 65_536] = ~(codes[x[k : k + 65_536]] == codes[y[k : k + 65_536]]).any(axis=1)
                x, y = x[fresh], y[fresh]
            np.add.at(found, x, counts[y])
            np.add.at(found, y, counts[x])
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                rp, rq = root(p), root(q)
                if rp != rq:
                    parent[rp] = rq
                    links.append((ids[p], ids[q]))
        some = np.flatnonzero(found)
        out = pd.DataFrame({"cls": ids[some], "n": found[some], "other": np.full(len(some), None, dtype=object)})
        more = pd.DataFrame({"cls": [a for a, _ in links], "n": 0, "other": [b for _, b in links]})
        return pd.concat([out, more], ignore_index=True)

    return run


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, bits: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = scratch.cut(rows.mapInArrow(_classes, "vec_id long, raw binary"), "vectors")
    usable = known.where(F.col("raw").isNotNull() & F.col("vec_id").isNotNull())
    key = [F.xxhash64("raw").alias("h1"), F.md5("raw").alias("h2")]
    classes = scratch.cut(usable.select("vec_id", "raw", *key).groupBy("h1", "h2").agg(F.min("vec_id").alias("cls"), F.count("*").alias("members"), F.first("raw").alias("raw")), "classes")
    n = classes.count()
    own_bits, _ = plan(n, threshold)
    bits = bits or own_bits
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    tables = math.ceil(math.log(MISS) / math.log(1 - meet))

    codes = scratch.cut(classes.select("cls", "members", "raw").mapInArrow(lean(_hash(bits, tables)), "cls long, members long, thin binary, codes array<long>"), "codes")
    stands = codes.select("cls", F.posexplode("codes").alias("table", "code"))
    sizes = scratch.cut(stands.groupBy("table", "code").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    # a row for each block pair that its block takes part in; blocks are dealt by hash
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = stands.join(sizes, ["table", "code"]).withColumn("g", blocks)
    dealt = (
        spread.withColumn("blk", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("g")).cast("int"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("cls", "table", "code", "blk", F.least("blk", "k").alias("i"), F.greatest("blk", "k").alias("j"))
    )
    # numbers travel until here; a vector then goes to its blocks in as few bytes as it has, and its codes are made there
    full = dealt.join(codes.select("cls", "members", "thin"), "cls")
    found = scratch.cut(full.groupBy("table", "code", "i", "j").applyInPandas(_compare(threshold, bits, tables), "cls long, n long, other long"), "found")

    links = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")), scratch, "vector-links")
    counts = found.where("n > 0").groupBy("cls").agg(F.sum("n").alias("n"))
    result = scratch.cut(
        classes.select("h1", "h2", "cls", "members").join(counts, "cls", "left").join(links.withColumnRenamed("id", "cls"), "cls", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id")),
        "class-result",
    )
    placed = known.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.xxhash64("raw")).alias("h1"), F.md5("raw").alias("h2"))
    placed = placed.withColumn("__salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)).cast("int"))
    result = result.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    out = placed.join(result, ["h1", "h2", "__salt"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
