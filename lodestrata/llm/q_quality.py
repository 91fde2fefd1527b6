"""op4: quality of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import quality
from .registry import register

#: A document is predicted good from this score on.
THRESHOLD = 0.3


@register("op4_quality")
def op4_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
