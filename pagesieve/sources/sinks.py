"""Sinks: record and rejection CSV, run summaries, logs, cached replies, page dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import lexicons as lx, text as tx, urls
from ..operators import entities as en

BOM = "﻿"
COLUMNS, REJECTIONS = lx.RECORD_COLUMNS, lx.REJECTION_COLUMNS
EVENT = ["ts", "level", "event", "logger", "run_id", "university", "span_id", "parent_span_id"]
_CSV = {"escape": '"', "emptyValue": "", "encoding": "UTF-8"}


def cells(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every column as a CSV cell: lists joined, two decimals, '' for null, formulas defused. Columns that are not there are empty."""
    kinds = dict(rows.dtypes)

    def cell(c: str) -> Column:
        if c not in kinds:
            return F.lit("").alias(c)
        if kinds[c].startswith("array"):
            v = tx.joined_cell(F.col(c).cast("array<string>"))
        elif kinds[c] in ("double", "float"):
            v = tx.two_decimals(F.col(c).cast("double"))
        else:
            v = F.col(c).cast("string")
        return tx.safe_cell(F.coalesce(v, F.lit(""))).alias(c)

    return rows.select(*(cell(c) for c in columns or COLUMNS))


def file_name(slug: str, field: str, stamp: str) -> str:
    """Name of a record file: university, first target field, time of the run."""
    import re

    short = re.sub("[^a-z0-9]+", "-", field.lower()).strip("-")[:30].strip("-") or "item"
    return f"{slug}__{short}__{stamp}.csv"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_records(records: DataFrame, folder: str, field: str, stamp: str) -> dict[str, str]:
    """folder/<university>/<university>__<field>__<stamp>.csv, with byte order mark and header, best records first; latest.csv is a copy. Paths by university.

    The plan runs once: one file per university, named and copied by the file system. Slugs serve as folder names.
    """
    spark = records.sparkSession
    target = f"{folder}/_{stamp}"
    rank = F.lpad(F.col("rank").cast("string"), 12, "0")
    place = en.numbered(records).select("*", urls.slug(F.col("university")).alias("_u"), rank.alias("_rank"))
    # ordered as the writer wants its folders, so that it does not order anew
    out = cells(place, [*COLUMNS, "_u", "_rank"]).repartition("_u").sortWithinPartitions("_u", "_rank").drop("_rank")
    out = out.withColumnRenamed(COLUMNS[0], BOM + COLUMNS[0])
    out.write.mode("overwrite").partitionBy("_u").options(header=True, **_CSV).csv(target)
    path, fs = _files(spark, target)
    path_of, copy = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.hadoop.fs.FileUtil.copy
    made = {}
    for status in fs.listStatus(path):
        if not status.isDirectory():
            continue
        slug = status.getPath().getName().removeprefix("_u=")
        part = next(f.getPath() for f in fs.listStatus(status.getPath()) if f.getPath().getName().startswith("part-"))
        home = path_of(f"{folder}/{slug}")
        fs.mkdirs(home)
        final = path_of(home, file_name(slug, field, stamp))
        fs.delete(final, False)
        fs.rename(part, final)
        copy(fs, final, fs, path_of(home, "latest.csv"), False, True, spark._jsc.hadoopConfiguration())
        made[slug] = f"{folder}/{slug}/{final.getName()}"
    fs.delete(path, True)
    return made


def append_rejections(rejections: DataFrame, folder: str) -> None:
    """Rejections added to a folder of CSV parts: byte order mark and header stand once, in a first part of their own."""
    spark = rejections.sparkSession
    path, fs = _files(spark, folder)
    head = spark._jvm.org.apache.hadoop.fs.Path(path, "part-00000-header.csv")
    cells(rejections, REJECTIONS).write.mode("append").options(header=False, **_CSV).csv(folder)
    if not fs.exists(head):
        stream = fs.create(head)
        stream.write(bytearray((BOM + ",".join(REJECTIONS) + "\n").encode()))
        stream.close()


def write_summary(results: DataFrame, path: str) -> None:
    """Totals over universities and the universities themselves (as many as a run has), as one JSON object."""
    numbers = [c for c, k in results.dtypes if k in ("int", "bigint", "double")]
    totals = F.struct(*(F.sum(c).alias(c) for c in numbers)).alias("totals")
    results.agg(totals, F.sort_array(F.collect_list(F.struct(*results.columns))).alias("universities")).coalesce(1).write.mode("overwrite").json(path)


def result_table(results: DataFrame) -> DataFrame:
    """university, pages, llm, kept, dropped, stopped ('host: reason' lines): the report at the end of a run, by slug.

    results: slug, pages_fetched, llm_calls, kept, rejected, blocked_hosts map.
    """
    stopped = F.array_join(F.transform(F.map_entries("blocked_hosts"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    named = results.select(F.col("slug").alias("university"), F.col("pages_fetched").alias("pages"), F.col("llm_calls").alias("llm"), "kept", F.col("rejected").alias("dropped"), F.coalesce(stopped, F.lit("")).alias("stopped"))
    return named.orderBy("university")


def append_cache(replies: DataFrame, path: str) -> None:
    """New replies (cache_key, reply), as classify.new_replies() gives them."""
    replies.select("cache_key", "reply").write.mode("append").parquet(path)


def call_log(calls: DataFrame, trace: bool = False) -> DataFrame:
    """file, line: a redacted JSON line per scorer call, named by its number and URL. Prompt and reply in full only with trace.

    calls: n, url, prompt, reply; other columns are logged as they are.
    """
    name = F.concat(F.lpad(F.col("n").cast("string"), 4, "0"), F.lit("-"), F.left(F.sha1("url"), F.lit(10)), F.lit(".json"))
    rest = [c for c in calls.columns if c not in ("prompt", "reply")]
    shown = ["prompt", "reply"] if trace else [F.sha2("prompt", 256).alias("prompt_sha256"), F.left("reply", F.lit(500)).alias("reply_preview")]
    return calls.select(name.alias("file"), tx.redacted(F.to_json(F.struct(*rest, *shown))).alias("line"))


def event_lines(events: DataFrame) -> DataFrame:
    """line: a redacted JSON line per event: the fixed fields first (null where unknown), then those of the struct fields that clash with none."""
    free = [f.name for f in events.schema["fields"].dataType.fields if f.name not in EVENT]
    fixed = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in EVENT]
    value = F.to_json(F.struct(*fixed, *(F.col(f"fields.{c}") for c in free)), {"ignoreNullFields": "false"})
    return events.select(tx.redacted(value).alias("line"))


def event_texts(events: DataFrame, limit: int = 160) -> DataFrame:
    """line: 'time level [university] event key=value ...' per event, for people; empty fields are left out, long ones cut."""
    kinds = events.schema["fields"].dataType.fields
    said = lambda f: F.col(f"fields.{f.name}").cast("string") if f.dataType.simpleString() in ("string", "int", "bigint", "double", "boolean") else F.to_json(f"fields.{f.name}")
    pairs = [F.when(~F.coalesce(said(f), F.lit("")).isin("", "[]", "{}"), F.concat(F.lit(f"{f.name}="), tx.shortened(F.replace(said(f), F.lit("\n"), F.lit("\\n")), limit))) for f in kinds]
    where = F.when(F.coalesce("university", F.lit("")) != "", F.concat(F.lit("["), F.col("university"), F.lit("]")))
    time = F.substring("ts", 12, 12)
    return events.select(tx.redacted(F.concat_ws(" ", time, F.rpad("level", 7, " "), where, "event", *pairs)).alias("line"))


def write_events(events: DataFrame, path: str) -> None:
    event_lines(events).write.mode("append").text(path)


def dump_index(pages: DataFrame) -> DataFrame:
    """file, url, status, bytes of each dumped page."""
    known = [c for c in ("status", "bytes") if c in pages.columns]
    return pages.select(F.concat(F.left(F.sha1("url"), F.lit(16)), F.lit(".html")).alias("file"), "url", *known)
