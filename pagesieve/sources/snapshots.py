"""Sources: snapshot tables, fetched bytes, cached replies, run summaries and logs. Nothing here opens a network connection."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import urls
from ..operators import html
from .config import ConfigError

LONGEST_ERROR = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Source(Protocol):
    """Where answers come from: any object with this method can stand in for the snapshot reader."""

    def fetches(self, spark: SparkSession) -> DataFrame:
        """url, status, headers map<string,string>, body binary, final_url, redirects, error."""


class Snapshot:
    """Answers kept in a table of Parquet files."""

    def __init__(self, path: str) -> None:
        self.path = path

    def fetches(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


class JsonSnapshot(Snapshot):
    """Answers kept as JSON lines, bodies as text."""

    def fetches(self, spark: SparkSession) -> DataFrame:
        fixed = "url string, status int, headers map<string,string>, body string, final_url string, redirects int, error string"
        return spark.read.schema(fixed).json(self.path).withColumn("body", F.encode("body", "utf-8"))


SOURCES = {"parquet": Snapshot, "json": JsonSnapshot}


def source(kind: str, path: str) -> Source:
    """The reader of that kind; an unknown kind is a ConfigError."""
    if kind not in SOURCES:
        raise ConfigError(f"unknown source {kind!r}: one of {', '.join(SOURCES)}")
    return SOURCES[kind](path)


def header(headers: Column, name: str) -> Column:
    """A header by its name in any case; '' if absent."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))


def answers(fetches: DataFrame, *, max_bytes: int = 3_000_000, most_redirects: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """fetches read as a client would: url, final_url, status, bytes, truncated, error, content_type, x_robots, retry_after, is_html, text.

    Bodies are cut at max_bytes; an error, or more redirects than a client follows, is status 0 with its message (at most
    500 characters) and no body. Columns in keep go along, since a URL does not name one fetch.
    """
    lost = F.col("error").isNotNull() | (F.coalesce("redirects", F.lit(0)) > most_redirects)
    message = F.when(lost, F.left(F.coalesce("error", F.lit("too many redirects")), F.lit(LONGEST_ERROR)))
    whole = F.coalesce("body", F.lit(b""))
    cut = F.when(lost, F.lit(b"")).otherwise(F.substring(whole, 1, max_bytes))
    kind = header(F.col("headers"), "content-type")
    rows = fetches.select(
        *keep,
        "url",
        F.coalesce(urls.canonical(F.col("final_url")), urls.canonical(F.col("url")), F.col("url")).alias("final_url"),
        F.when(lost, 0).otherwise(F.col("status")).alias("status"),
        F.octet_length(cut).alias("bytes"),
        (~lost & (F.octet_length(whole) > max_bytes)).alias("truncated"),
        message.alias("error"),
        kind.alias("content_type"),
        html.robots_tags(header(F.col("headers"), "x-robots-tag")).alias("x_robots"),
        header(F.col("headers"), "retry-after").try_cast("double").alias("retry_after"),
        header(F.col("headers"), "cf-mitigated").alias("mitigated"),
        html.decoded(cut, kind).alias("text"),
    )
    return rows.withColumn("is_html", html.is_html(F.col("content_type"), F.col("text")))


def universities(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All JSON files of a folder, by slug; a slug that occurs twice is an error."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.json(f"{folder}/*.json", multiLine=True)
    twice = [r.slug for r in df.groupBy("slug").count().where("count > 1").limit(5).collect()]
    if twice:
        raise ConfigError(f"slugs occur twice: {', '.join(twice)}")
    return df.orderBy("slug")


def cached_replies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cache_key string, reply string").parquet(path)


def run_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def log_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a run log: fixed columns, and the whole line as a variant."""
    fixed = "ts string, level string, event string, logger string, run_id string, university string, span_id string, parent_span_id string"
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", fixed).alias("e"), F.try_parse_json("value").alias("payload")).select("e.*", "payload")


__all__ = ["ConfigError", "JsonSnapshot", "SOURCES", "Snapshot", "Source", "answers", "cached_replies", "header", "log_events", "run_summary", "source", "table", "universities"]
