"""Exact order statistics of many weighted columns at once, without a column's values in one place.

The value at a rank lies in one bucket of a histogram; that bucket is cut into a finer histogram, and so on until few
enough values are left to be sorted. Each round is one aggregate over all columns, with map-side combine, and brings
the driver two rows a column at most.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a column that one task may sort.
FEW = 50_000
BUCKETS = 1_024


@dataclasses.dataclass(frozen=True)
class Sought:
    """A rank that is sought in [low, high], which hold ``size`` values with weights ``before`` them."""

    col: int
    rank: int
    low: float
    high: float
    before: int
    size: int


def _scaled(x: Column) -> Column:
    """Rises with x, evenly in orders of magnitude, so that no outlier leaves all others in one bucket."""
    return F.signum(x) * F.log1p(F.abs(x))


def _beside(rows: DataFrame, sought: list[Sought]) -> DataFrame:
    """The rows within each sought interval; there are two a column at most."""
    own = rows.sparkSession.createDataFrame([(s.col, s.rank, s.low, s.high, s.before) for s in sought], "col int, rank long, low double, high double, before long")
    return rows.join(F.broadcast(own), "col").where(F.col("x").between(F.col("low"), F.col("high")))


def _narrowed(rows: DataFrame, sought: list[Sought]) -> list[Sought]:
    a, b, x = _scaled(F.col("low")), _scaled(F.col("high")), _scaled(F.col("x"))
    even = (F.col("x") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    bucket = F.least(F.floor(F.coalesce((x - a) / F.nullif(b - a, F.lit(0.0)), even, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1))
    counted = _beside(rows, sought).groupBy("col", "rank", "before", bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("size"))
    up_to = F.sum("n").over(Window.partitionBy("col", "rank").orderBy("bucket"))
    placed = counted.withColumn("after", F.col("before") + up_to).where(F.col("after") > F.col("rank"))
    first = placed.groupBy("col", "rank").agg(F.min_by(F.struct("low", "high", F.col("after") - F.col("n"), "size"), "bucket").alias("b"))
    return [Sought(r["col"], r["rank"], *r["b"]) for r in first.collect()]


def _sorted(rows: DataFrame, sought: list[Sought]) -> dict[tuple[int, int], float]:
    by_value = _beside(rows, sought).groupBy("col", "rank", "before", "x").agg(F.sum("n").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("col", "rank").orderBy("x"))
    found = by_value.withColumn("after", F.col("before") + up_to).where(F.col("after") > F.col("rank")).groupBy("col", "rank").agg(F.min("x").alias("x"))
    return {(r["col"], r["rank"]): r["x"] for r in found.collect()}


def medians(rows: DataFrame, bounds: dict[int, tuple[float, float, int, int]], few: int = FEW) -> dict[int, float]:
    """Weighted medians by column of ``rows`` (col, x, n) without nulls; the mean of the two middle values.

    ``bounds``: column -> (a lower bound of x, an upper one, the sum of n, rows at most). Columns without weight are
    left out of the result.
    """
    bounds = {c: b for c, b in bounds.items() if b[2]}
    middle = {c: sorted({(b[2] - 1) // 2, b[2] // 2}) for c, b in bounds.items()}
    open_ = [Sought(c, r, b[0], b[1], 0, b[3]) for c, b in bounds.items() for r in middle[c]]
    found: dict[tuple[int, int], float] = {}
    while open_:
        found |= {(s.col, s.rank): s.low for s in open_ if s.low == s.high}
        open_ = [s for s in open_ if s.low != s.high]
        near = [s for s in open_ if s.size <= few]
        if near:
            found |= _sorted(rows, near)
        open_ = [s for s in open_ if s.size > few]
        if open_:
            open_ = _narrowed(rows, open_)
    out = {}
    for c, ranks in middle.items():
        a, b = (found[c, r] for r in (ranks[0], ranks[-1]))
        out[c] = a if a == b or math.isinf(a) else a * 0.5 + b * 0.5
    return out
