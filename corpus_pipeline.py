"""Corpus pipeline over ``documents``: the stages, in order, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the rows that it keeps with the columns of
``documents``; the last adds the token ids. Null or empty texts pass through every filter (no stage
has a reason to reject them, so the quality stage does not judge them); an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, minhash, pieces, quality, substring_dedup
from lodestrata.llm.scratch import Scratch, small_batches

#: Documents under this probability of being good go.
QUALITY_THRESHOLD = 0.3
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5
PIECES = "piece_bpe_32k.model"


def quality_filter(spark, docs, sf_dir):
    """Documents that the compression classifier does not reject."""
    small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, "__quality")
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")
    return scored.where(blank | (F.col("__quality") >= QUALITY_THRESHOLD)).select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """One document, that with the smallest doc_id, of each group of near-duplicates."""
    return minhash.keep_one(docs, Scratch(spark), SHINGLE)


def substring_cut(spark, docs, sf_dir):
    """Every document, without the passages that an earlier one has."""
    cut = substring_dedup.remove_repeats(docs, Scratch(spark))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark, docs, sf_dir):
    """Documents in which no benchmark window occurs."""
    small_batches(spark)
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hit_spans") == 0).select(*docs.columns)


def encoding(spark, docs, sf_dir):
    """Every document with its SentencePiece ids and the text decoded from them."""
    small_batches(spark)
    coded = pieces.encode(docs, public_tokenizers.path(PIECES))
    return coded.select("doc_id", F.col("decoded").alias("text"), *[c for c in docs.columns if c not in ("doc_id", "text")], "ids", "n_tokens", "ids_crc32", "score", "n_best_scores", "round_trip")


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_cut),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: A trained classifier and token ids are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The pipeline's rows; each stage is written and read again before the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs, f"stage-{k}")
            scratch.drop(f"stage-{k - 1}")
    return docs
