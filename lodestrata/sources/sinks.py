"""Writers of repaired tables and audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store


def write_csv(cells: DataFrame, header: list[str], path: str, delimiter: str = ",", single: bool = False) -> str:
    """Rows of (row_no, c0 ... cN) with a header, in row order, as part files of a folder.

    ``single`` makes one part file, for tables that one task can write.
    """
    named = cells.repartitionByRange("row_no").sortWithinPartitions("row_no") if not single else cells.coalesce(1).sortWithinPartitions("row_no")
    columns = [F.col(f"c{i}").alias(f"c{i}") for i in range(len(header))]
    named.select(*columns).write.mode("overwrite").option("sep", delimiter).option("header", False).option("escape", '"').option("emptyValue", "").option("lineSep", "\n").csv(path)
    return path


def escaped(value: Column) -> Column:
    """A value that a spreadsheet might run, made harmless: as JSON text behind a mark."""
    risky = F.regexp_replace(value, "\\A\\s+", "").rlike("\\A[=+\\-@]")
    return F.when(risky, F.concat(F.lit("json:"), F.to_json(F.struct(value.alias("v"))))).otherwise(value)


def audit_log(repair, source_sha: str = "") -> DataFrame:
    """line, column, rule, confidence, before, after of every change, and a row for every dropped duplicate."""
    changes = repair.changes
    private = F.col("column").isin(*repair.private) if repair.private else F.lit(False)
    rows = changes.select(
        (F.col("row_no") + 2).alias("line"), "column", "rule", "confidence",
        F.when(private, "[withheld]").otherwise(escaped(F.col("before"))).alias("before"),
        F.when(private, "[withheld]").otherwise(escaped(F.col("after"))).alias("after"),
    )
    if repair.dropped is not None:
        cells = F.lit("[withheld]") if repair.private else F.col("cells")
        rows = rows.unionByName(repair.dropped.select((F.col("row_no") + 2).alias("line"), F.lit("").alias("column"), F.lit("drop-duplicates").alias("rule"), F.lit("high").alias("confidence"), cells.alias("before"), F.concat(F.lit("kept line "), (F.col("kept_row") + 2).cast("string"), F.when(F.col("matched_after_normalization"), " (equal after repair)").otherwise("")).alias("after")))
    if source_sha:
        spark = changes.sparkSession
        rows = rows.unionByName(spark.createDataFrame([(0, "", "source", "", source_sha, "")], rows.schema))
    return rows


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small report, written whole or not at all, wherever Spark writes."""
    store.put(spark, path, text.encode())
