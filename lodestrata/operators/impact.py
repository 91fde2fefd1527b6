"""What defects do to an aggregate: as a loader would coerce the raw text, and after repair.

Raw and repaired values stand side by side in the dictionary, so what concerns one column is a single aggregate over
it, weighted by counts; rows are scanned only where two columns meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from .config import Config
from .profile import Profiled
from .repair import Repair, plan
from .rows import repeated_rows


class ImpactError(Exception):
    """An aggregate that cannot be stated."""


def prepare(done: Profiled, config: Config | None = None) -> Repair:
    """The repair that all impacts share."""
    return plan(done, config, "medium")


def _measure(repair: Repair, column: str) -> int:
    i = repair.done.table.find(column)
    if i is None:
        raise ImpactError(f"{column!r} is no column")
    reading = repair.done.columns[i].number_reading
    if not reading.usable:
        raise ImpactError(f"the number convention of {column!r} is {reading.label}")
    return i


def coerced(v: Column) -> Column:
    """The number that a strict loader takes the text for."""
    return F.when(~X.is_blank(v), N.strict_double(v))


def fixed(v: Column) -> Column:
    return N.parse_number(v)["value"]


def sum_impact(repair: Repair, column: str) -> DataFrame:
    """One row: coerced and repaired totals, their difference, and the three causes that add up to it."""
    raw, n = F.col("value"), F.col("n")
    rows = repair.values_of(_measure(repair, column)).select("n", X.is_blank(raw).alias("blank"), coerced(raw).alias("a"), fixed(F.col("fixed")).alias("b"))
    recovered = ~F.col("blank") & F.col("a").isNull() & F.col("b").isNotNull()
    removed = F.col("a").isNotNull() & F.col("b").isNull() & (F.col("a") != 0)
    lost = ~F.col("blank") & F.col("a").isNull() & F.col("b").isNull()
    total = lambda c: F.coalesce(F.sum(c * n), F.lit(0.0))
    count = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    out = rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        total(F.col("a")).alias("coerced_total"),
        count(F.col("a").isNotNull()).alias("coerced_rows"),
        total(F.col("b")).alias("repaired_total"),
        count(F.col("b").isNotNull()).alias("repaired_rows"),
        count(recovered).alias("recovered_rows"),
        total(F.when(recovered, F.col("b"))).alias("recovered_amount"),
        count(removed).alias("removed_rows"),
        total(F.when(removed, -F.col("a"))).alias("removed_amount"),
        count(lost).alias("still_lost_rows"),
        (count(~F.col("blank") & F.col("a").isNull()) == 0).alias("loads_as_number"),
    )
    return out.withColumn("difference", F.col("repaired_total") - F.col("coerced_total"))


def aggregate_impact(repair: Repair, column: str) -> DataFrame:
    """One row: AVG, MIN and MAX, coerced and repaired; NULL where no value counts."""
    rows = repair.values_of(_measure(repair, column)).select("n", coerced(F.col("value")).alias("a"), fixed(F.col("fixed")).alias("b"))
    mean = lambda c: F.sum(c * F.col("n")) / F.sum(F.when(c.isNotNull(), F.col("n")))
    return rows.agg(*[fn(F.col(c)).alias(f"{name}_{when}") for name, fn in (("avg", mean), ("min", F.min), ("max", F.max)) for c, when in (("a", "coerced"), ("b", "repaired"))])


def group_impact(repair: Repair, column: str, measure: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row of groups before and after and the misplaced share, the merges by amount)."""
    g = repair.done.table.find(column)
    if g is None:
        raise ImpactError(f"{column!r} is no column")
    if measure is None:
        rows = repair.values_of(g).select(F.col("first_row").alias("row_no"), F.col("value").alias("raw"), "fixed", F.col("n").cast("double").alias("w"))
    else:
        weight = F.coalesce(F.abs(fixed(F.col(f"r{_measure(repair, measure)}"))), F.lit(0.0))
        rows = repair.every_row.select("row_no", F.col(f"c{g}").alias("raw"), F.col(f"r{g}").alias("fixed"), weight.alias("w"))
    moved = (F.col("raw") != F.col("fixed")) & ~X.is_blank(F.col("fixed"))
    whole = rows.agg(
        F.count_distinct(F.when(~X.is_blank(F.col("raw")), F.col("raw"))).alias("groups_before"),
        F.count_distinct(F.when(~X.is_blank(F.col("fixed")), F.col("fixed"))).alias("groups_after"),
        (F.coalesce(F.sum(F.when(moved, F.col("w"))), F.lit(0.0)) / F.nullif(F.sum("w"), F.lit(0.0))).alias("misplaced_share"),
    )
    merges = rows.where(moved).groupBy("fixed").agg(F.array_sort(F.collect_set("raw")).alias("sources"), F.sum("w").alias("amount"), F.min("row_no").alias("first_row")).orderBy(F.desc("amount"), "first_row").drop("first_row")
    return whole, merges


def duplicate_impact(repair: Repair, measure: str | None = None) -> DataFrame:
    """One row: repeated raw rows, and how much of the repaired measure they add again."""
    again = repeated_rows(repair.source, repair.done.table.columns)
    if measure is None:
        return again.agg(F.count("*").alias("duplicate_rows"), F.lit(0.0).alias("duplicate_amount"))
    i = _measure(repair, measure)
    rows = again.join(repair.every_row.select("row_no", fixed(F.col(f"r{i}")).alias("v")), "row_no")
    return rows.agg(F.count("*").alias("duplicate_rows"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("duplicate_amount"))
