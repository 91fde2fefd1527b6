"""op6: token ids of ``documents`` through the binary shards."""

from __future__ import annotations

import public_tokenizers

from .registry import register
from .tokens import read_shards, write_shards

TOKENIZER = "byte_bpe_50k.json"


@register("op6_token_shards")
def op6_token_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(spark, write_shards(docs, public_tokenizers.path(TOKENIZER)))
