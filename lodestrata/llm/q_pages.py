"""op8: main text of every page."""

from __future__ import annotations

from .registry import register
from .scratch import Scratch
from .wrappers import main_text


@register("op8_html_wrappers")
def op8_html_wrappers(spark, sf_dir):
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark))
