"""op3: SentencePiece encoding and decoding of every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import pieces
from .registry import register

MODEL = "piece_bpe_32k.model"


@register("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = pieces.encode(docs, public_tokenizers.path(MODEL))
    return coded.select("doc_id", "n_tokens", "ids_crc32", "score", "n_best_scores", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "round_trip")
