"""The registered queries of the operators, over whole tables, and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import anchors, bpe, compression, jaccard, langid, licenses, mixing, negatives, phrases, pieces, sketch, sql, suffixes, toxicity


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


TOKENIZER = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"

REGISTRY: dict[str, Query] = {
    "op1_jaccard_join": Query(documents(jaccard.match), sql.JACCARD),
    "op1_jaccard_links": Query(documents(jaccard.count_links), sql.JACCARD_LINKS),
    "op2_fingerprints": Query(documents(sketch.fingerprint)),
    "op3_suffix_dedup": Query(documents(suffixes.digests)),
    "op4_language": Query(documents(langid.identify)),
    "op5_byte_bpe": Query(documents(lambda docs: bpe.digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN))),
    "op6_toxicity": Query(lambda spark, sf_dir: toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))),
    "op7_quality_rules": Query(documents(compression.judge)),
    "op8_source_mix": Query(documents(mixing.mix), sql.MIX),
    "op9_substring_dedup": Query(documents(anchors.digests), sql.WINDOWS_13),
    "op10_license_scan": Query(documents(licenses.scan), sql.LICENSES),
    "op11_sentencepiece": Query(documents(lambda docs: pieces.digests(docs, public_tokenizers.path(PIECES)))),
    "op12_collocations": Query(documents(phrases.collocations), sql.COLLOCATIONS),
    "op13_hard_negatives": Query(lambda spark, sf_dir: negatives.contract(table(spark, sf_dir, "embeddings")), sql.NEGATIVES),
}
