"""Queries of the streaming forms, run on tables as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.monitor import windowed_health
from .catalog import register


@register("stream_window_health", "SELECT date_trunc('hour', ts) AS start, count(*) AS n_rows, CAST(count(*) FILTER (event_id % 10 = 0) AS BIGINT) AS n_null, CAST(count(*) FILTER (event_id % 10 <> 0) AS BIGINT) AS n_numbers, round(avg(floor(value)) FILTER (event_id % 10 <> 0), 6) AS mean FROM events GROUP BY 1")
def stream_window_health(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts"), F.expr("CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END").alias("v"))
    return windowed_health(rows, "ts", "v").withColumn("mean", F.round("mean", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))
