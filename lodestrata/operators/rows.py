"""Rows that are equal in many cells, found by fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Repeated fingerprints that are sent to every task.
FEW_REPEATED = 200_000


def fingerprint(cells: list[str]) -> list[Column]:
    """128 bits of a row's cells, as two numbers."""
    return [F.xxhash64(F.lit(k), *[F.col(c) for c in cells]).alias(f"__f{k}") for k in (1, 2)]


def _suspects(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows, which have their fingerprint beside them, whose fingerprint is among ``marks`` more than once.

    Counted first: where few repeat, they are sent to every task and rows stay where they are; where many do, rows meet
    them by a shuffle.
    """
    again = marks.groupBy("__f1", "__f2").agg(F.count("*").alias("n")).where("n > 1").select("__f1", "__f2").persist()
    some = F.broadcast(again) if again.count() <= FEW_REPEATED else again
    return rows.join(some, ["__f1", "__f2"], "left_semi")


def repeated_rows(df: DataFrame, cells: list[str]) -> DataFrame:
    """row_no and kept_row of rows whose cells are those of an earlier row.

    Fingerprints and row numbers travel, whatever a row's width; cells only of rows whose fingerprint occurs again,
    to make sure that they are equal.
    """
    suspects = _suspects(df.select("row_no", *cells, *fingerprint(cells)), df.select(*fingerprint(cells)))
    first = suspects.groupBy("__f1", "__f2", *cells).agg(F.min("row_no").alias("kept_row"), F.count("*").alias("n")).where("n > 1").drop("n")
    return suspects.join(first, ["__f1", "__f2", *cells]).where("row_no > kept_row").select("row_no", "kept_row")


def repeated_groups(df: DataFrame, cells: list[str]) -> DataFrame:
    """(the cells, n, first_row) of every row text that occurs more than once, as ``repeated_rows`` finds it."""
    marks = {f"__f{k + 1}": m for k, m in enumerate(fingerprint(cells))}
    suspects = _suspects(df.withColumns(marks), df.select(*fingerprint(cells)))
    return suspects.groupBy(*marks, *cells).agg(F.count("*").alias("n"), F.min("row_no").alias("first_row")).where("n > 1").drop(*marks)
