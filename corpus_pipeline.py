"""Corpus pipeline: quality, near duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last return
the columns of documents. run() writes each stage's result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagesieve.llm import mixing, neardup, packing, quality, secretscan
from pagesieve.llm.common import discard, documents, stored
from pagesieve.llm.queries import TOKENIZERS, labels


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; without labels of both classes none does. Nulls and repeats are judged like any row."""
    return quality.good_documents(docs, labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8). Rows without an id and empty texts: see neardup.one_per_class."""
    return neardup.one_per_class(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows, and is null where the text is. Every row stays."""
    clean = secretscan.redacted(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as their fitted rate says, so that languages reach their tempered shares. Rows without an id share one draw."""
    return mixing.mixed(docs, labels(spark, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left, a row per row; null and empty texts have length 0."""
    return packing.packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_to_targets),
    ("packing", pack),
]

#: SQL has neither trained classifiers nor compression or gradient steps: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{k + 1}")
        discard(before)
    return docs
