"""One query per corpus operator, over its whole table, and the pipeline of corpus_pipeline.py."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cws, gif, mixing, neardup, packing, passages, quality, secretscan, tokencount, toxicity
from .common import documents

TOKENIZERS = os.environ.get("PAGESIEVE_TOKENIZERS", "/opt/tokenizers")
REPEAT_WORDS = 50


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), similarity=0.8, shingle_words=4)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, labels(spark, sf_dir)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir), f"{TOKENIZERS}/piece_bpe_32k.model")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digests(documents(spark, sf_dir))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir), words=REPEAT_WORDS)


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.compared_with_edits(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_minhash_near_duplicates, op2_toxicity, op3_packing, op4_mixing, op5_token_counts, op6_secret_scan, op7_quality, op8_gif_media, op9_passage_dedup, op10_weighted_sampling)
    return {f.__name__: f for f in (*ops, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op9_passage_dedup": passages.passages_sql(REPEAT_WORDS)}
