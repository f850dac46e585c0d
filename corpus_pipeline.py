"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, repeated
passages go, sources are mixed to weights, and what is left is encoded.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns the
documents for the next stage, with the columns of ``documents``; the last returns token ids.
Each stage is meant to be written and read again before the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from creditloom.llm import anchors, bpe, jaccard, mixing, toxicity
from creditloom.llm.common import checkpoint

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return anchors.shortened(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_table(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, carry=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can't express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
