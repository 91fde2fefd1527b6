"""Column health of a stream: null rates and medians by event-time window, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X


def windowed_health(rows: DataFrame, time: str, column: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, n_rows, n_null, n_numbers, mean) of a text column by window; works on streams and on tables."""
    v = F.col(column)
    number = N.parse_number(v)["value"]
    own = rows.withWatermark(time, late) if rows.isStreaming else rows
    return (
        own.groupBy(F.window(F.col(time), width))
        .agg(F.count("*").alias("n_rows"), F.count_if(v.isNull() | X.is_null_token(v)).alias("n_null"), F.count(number).alias("n_numbers"), F.avg(number).alias("mean"))
        .select(F.col("window.start").alias("start"), "n_rows", "n_null", "n_numbers", "mean")
    )
