"""op10: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import quality, toxicity
from .registry import register

THRESHOLD = 0.5


@register("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
