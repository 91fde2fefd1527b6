"""op5: language-model score of every document."""

from __future__ import annotations

from . import ppm
from .registry import register
from .scratch import Scratch


@register("op5_ppm_score")
def op5_ppm_score(spark, sf_dir):
    return ppm.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
