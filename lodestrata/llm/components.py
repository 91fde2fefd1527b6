"""Distributed connected components of a table of links.

Links are first thinned where they lie: every partition runs a union-find over its own links and keeps
one link a vertex. Then large-star and small-star rounds alternate until nothing changes; each is an
aggregate with map-side combine and a join whose popular key (a component's root) is dealt over
``SALT`` pieces. Nothing is collected and each round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .workers import lean

SALT = 16


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    out = [(x, root(x)) for x in parent]
    for at in range(0, len(out), 50_000):
        part = [x for x in out[at : at + 50_000] if x[0] != x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())], names=["a", "b"])


def salted(big: DataFrame, small: DataFrame, key: str, spread: str, how: str = "left") -> DataFrame:
    """``big`` joined with ``small``, whose ``key`` is unique, with popular keys dealt over SALT pieces."""
    dealt = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    return big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")).join(dealt, [key, "__salt"], how).drop("__salt")


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(id, component) of every id in ``links`` (a, b) that is not its component's smallest id."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges = scratch.cut(links.mapInArrow(lean(_thin), "a long, b long"), name)
    mark = _mark(edges)
    if not mark[0]:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    while True:
        # small star: a vertex and its smaller neighbours all point to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = scratch.cut(small, name)
        # large star: larger neighbours of a vertex point to its smallest neighbour
        least = scratch.cut(edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")), f"{name}-least")
        large = salted(edges, least, "b", "a").select("a", F.coalesce("m", "b").alias("b")).distinct()
        edges = scratch.cut(large, name)
        now = _mark(edges)
        if now == mark:
            scratch.drop(f"{name}-least")
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        mark = now


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
