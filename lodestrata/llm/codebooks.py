"""Product quantisation of vectors in whole numbers, the nearest entry found among those of like norm.

A component x becomes floor(256 x). A vector is cut into ``PARTS`` equal parts, and each part position has a codebook
of ``ENTRIES`` entries, which starts as that part of the vectors with the smallest ids. A round assigns every part to
its nearest entry and moves each entry to the floor of its parts' mean; an entry without parts stays. All sums,
squares and means are exact.

Entries are sorted by norm. As |norm(x) - norm(e)| is at most the distance of x and e, only entries whose norms lie
within the best distance so far of norm(x) can be as near. The entries of the closest norms give a first distance, two
binary searches give the annulus that this allows, and entries inside, both ends included, are evaluated exactly from
the closest norm outwards, the annulus narrowing as better ones are found, until none inside is left. Ties go to the
entry with the lower index.

Vectors that are null, or hold a null or non-finite component, are dropped. The dimension is that of the kept vector
with the smallest id (null ids last, equal ids by their vectors). Vectors of another dimension, and such with a
component beyond ``LARGEST``, stay as rows with a null code and error and are not learnt from; if the dimension is no
multiple of ``PARTS`` all are such rows. Repeated rows count each. Fewer than ``ENTRIES`` vectors make a smaller
codebook, and an empty table gives no rows. Other columns stay, but those that the result adds are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import slices
from .components import SALT
from .scratch import Scratch, apart
from .workers import lean

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Largest magnitude of a whole-number component, so that sums of squares fit 64 bits.
LARGEST = 1 << 22
#: Entries of the closest norms that give a part its first distance.
FIRST = 4
#: Pairs of a part and an entry that are evaluated at once.
PAIRS = 400_000
#: Labels whose sums are sent to every task; beyond it they are joined by a salted shuffle.
FEW_LABELS = 50_000


class Codebook:
    """Entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.index = np.argsort(squares, kind="stable")
        self.entries = np.ascontiguousarray(entries[self.index])
        self.norms = np.sqrt(squares[self.index].astype(np.float64))
        self.evaluated = 0

    def _key(self, x: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Squared distance and index of an entry in one number, smaller for a nearer or an earlier one."""
        self.evaluated += len(row)
        gap = x[row] - self.entries[place]
        return np.einsum("ij,ij->i", gap, gap) * len(self.index) + self.index[place]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry."""
        size, rows = len(self.index), np.arange(len(x))
        norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        low = np.clip(np.searchsorted(self.norms, norm) - FIRST // 2, 0, max(size - FIRST, 0))
        high = np.minimum(low + FIRST, size)
        best = self._key(x, rows, low)
        for k in range(1, min(FIRST, size)):
            np.minimum(best, self._key(x, rows, low + k), out=best)
        step = FIRST
        while len(rows):
            # the annulus, its ends moved out by more than the roundings of three square roots
            reach = np.sqrt((best[rows] // size).astype(np.float64))
            slack = (norm[rows] + reach + 1) * 1e-12
            first = np.searchsorted(self.norms, norm[rows] - reach - slack, "left")
            last = np.searchsorted(self.norms, norm[rows] + reach + slack, "right")
            a, b = np.maximum(first, low[rows] - step), np.minimum(last, high[rows] + step)
            self._evaluate(x, best, rows, a, low[rows])
            self._evaluate(x, best, rows, high[rows], b)
            low[rows], high[rows] = np.minimum(a, low[rows]), np.maximum(b, high[rows])
            rows = rows[(first < low[rows]) | (last > high[rows])]
            step *= 2
        return best % size, best // size

    def _evaluate(self, x: np.ndarray, best: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Lowers ``best`` of each row by the entries from ``first`` up to ``last``."""
        some = last > first
        rows, first, last = rows[some], first[some], last[some]
        ends = np.concatenate([[0], np.cumsum(last - first)])
        for i, j in slices(ends, PAIRS):
            own, counts, starts = rows[i:j], np.diff(ends[i : j + 1]), ends[i:j] - ends[i]
            place = np.arange(ends[j] - ends[i]) - np.repeat(starts - first[i:j], counts)
            keys = self._key(x, np.repeat(own, counts), place)
            best[own] = np.minimum(best[own], np.minimum.reduceat(keys, starts))


def whole(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as whole numbers in doubles; None for those that are dropped."""
    out: list[np.ndarray | None] = [None] * len(column)
    for i, x in enumerate(column):
        v = x.values
        if v is not None and not v.null_count:
            own = np.floor(v.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            out[i] = own if np.isfinite(own).all() else None
    return out


def _parts(kept: int):
    """The whole-number components as bytes of int64, null if one is beyond LARGEST; dropped vectors go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = whole(batch.column(kept))
            stay = pa.array([i for i, v in enumerate(vectors) if v is not None], pa.int64())
            raw = [v.astype("<i8").tobytes() if (np.abs(v) <= LARGEST).all() else None for v in vectors if v is not None]
            size = [len(v) for v in vectors if v is not None]
            yield pa.RecordBatch.from_arrays([*[c.take(stay) for c in batch.columns[:kept]], pa.array(size, pa.int32()), pa.array(raw, pa.binary())], names=[str(k) for k in range(kept + 2)])

    return run


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a value, their numbers as a matrix)."""
    raw = column.drop_null()
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    return at, np.frombuffer(b"".join(raw.to_pylist()), "<i8").reshape(len(at), width)


def _assign(books: list[Codebook], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = numbers.shape[1] // PARTS
    found = [book.nearest(np.ascontiguousarray(numbers[:, k * width : (k + 1) * width])) for k, book in enumerate(books)]
    return np.stack([x for x, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _sums(entries: np.ndarray):
    """What each task's parts add up to, an entry a row."""
    parts, size, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        count, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for batch in batches:
            _, numbers = _matrix(batch.column(0), parts * width)
            if not len(numbers):
                continue
            codes, _ = _assign(books, numbers)
            for k in range(parts):
                count[k] += np.bincount(codes[:, k], minlength=size)
                np.add.at(total[k], codes[:, k], numbers[:, k * width : (k + 1) * width])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    return run


def _moved(entries: np.ndarray, rows: DataFrame) -> np.ndarray:
    """The codebooks after a round; the driver gets one row an entry."""
    width = entries.shape[2]
    sums = rows.mapInArrow(lean(_sums(entries)), "part int, entry int, n long, total array<long>")
    grouped = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(width)])
    moved = entries.copy()
    for r in grouped.collect():
        moved[r["part"], r["entry"]] = [int(r[f"t{k}"]) // r["n"] for k in range(width)]
    return moved


def _codes(entries: np.ndarray, kept: int):
    parts, _, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        for batch in batches:
            n = batch.num_rows
            usable = np.array(batch.column(kept).to_pylist(), bool)
            raw = pa.array([x if u else None for x, u in zip(batch.column(kept + 1).to_pylist(), usable, strict=True)], pa.binary())
            at, numbers = _matrix(raw, parts * width)
            code, error = np.full(n, None, object), np.zeros(n, np.int64)
            if len(at):
                codes, squares = _assign(books, numbers)
                digits = codes.astype(np.uint8).tobytes().hex()
                code[at] = [digits[2 * parts * k : 2 * parts * (k + 1)] for k in range(len(at))]
                error[at] = squares.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=~usable)], names=[str(k) for k in range(kept + 2)])

    return run


def digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def _with_label_error(coded: DataFrame, label: str, scratch: Scratch, own: str) -> DataFrame:
    """``coded`` plus the errors of all rows with its label; a hot label is pre-aggregated and never one task's."""
    sums = scratch.cut(coded.groupBy(F.col(f"`{label}`").alias(f"{own}label")).agg(F.sum("error").alias("label_error")), "label-errors")
    same = F.col(f"`{label}`").eqNullSafe(F.col(f"{own}label"))
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), same).drop(f"{own}label")
    salted = coded.withColumn(f"{own}salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int"))
    copies = sums.withColumn(f"{own}copy", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    return salted.join(copies, same & (F.col(f"{own}salt") == F.col(f"{own}copy"))).drop(f"{own}label", f"{own}salt", f"{own}copy")


def compress(vectors: DataFrame, scratch: Scratch, label: str = "label", rounds: int = ROUNDS, size: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """(``vectors`` (vec_id, embedding, label) without embedding, plus code, error and label_error; the codebooks)."""
    own = apart(vectors.columns)
    kept = [c for c in vectors.columns if c not in ("embedding", "code", "error", "label_error")]
    rows = vectors.select(*[F.col(f"`{c}`") for c in kept], F.col("embedding").cast("array<double>").alias(f"{own}vector"))
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    numbers = scratch.cut(rows.mapInArrow(lean(_parts(len(kept))), f"{named}, {own}size int, {own}raw binary"), "whole-vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col(f"{own}size"), F.col(f"{own}raw")]
    start = numbers.orderBy(*order).select(f"{own}size").limit(1).collect()
    dimension = start[0][0] if start else 0
    fits = (F.col(f"{own}size") == dimension) & F.col(f"{own}raw").isNotNull() & F.lit(dimension % PARTS == 0)
    usable = numbers.where(fits)
    first = usable.orderBy(*order).select(f"{own}raw").limit(size).collect()
    entries = np.frombuffer(b"".join(bytes(r[0]) for r in first), "<i8").reshape(len(first), PARTS, dimension // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        entries = _moved(entries, usable.select(f"{own}raw"))
    coded = numbers.select(*[F.col(f"`{c}`") for c in kept], fits.alias(f"{own}fits"), f"{own}raw")
    coded = scratch.cut(coded.mapInArrow(lean(_codes(entries, len(kept))), f"{named}, code string, error long"), "codes")
    return _with_label_error(coded, label, scratch, own), entries
