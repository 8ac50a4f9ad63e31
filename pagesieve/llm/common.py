"""Helpers shared by the corpus operators: input projection and tables in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import Batches, discard, mapped, shared_dir, stored, trim

__all__ = ["Batches", "discard", "documents", "few", "free_name", "id_text", "mapped", "shared_dir", "stored", "trim", "union_all"]
_ROWS_PER_FILE = 250_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only (doc_id long, text string): extra columns of any name never reach an operator. Null text is ''."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def few(df: DataFrame, rows: int) -> DataFrame:
    """df of at most so many rows in no more partitions than they need: a small table is one file, not one per shuffle partition."""
    return df.coalesce(max(1, -(-rows // _ROWS_PER_FILE)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)
