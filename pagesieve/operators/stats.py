"""Run statistics: counters, timings, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import discard, stored


def timing_summary(timings: DataFrame, by: str, value: str) -> DataFrame:
    """Per key: count, total, avg, p95, max, rounded to 1 decimal. p95 is the element at round-half-even(0.95 (n - 1)) of the sorted values.

    Values meet as counts per distinct value, ranked by a running sum: no list of all values is built.
    """
    from pyspark.sql import Window as W

    per = timings.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    total = per.groupBy(by).agg(F.sum("k").alias("n"), F.sum(F.col("v") * F.col("k")).alias("total"), F.max("v").alias("top"))
    upto = per.withColumn("upto", F.sum("k").over(W.partitionBy(by).orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    at = F.bround(F.lit(0.95) * (F.col("n") - 1)).cast("bigint")
    p95 = upto.join(total.select(by, "n"), by).where(F.col("upto") > at).groupBy(by).agg(F.min("v").alias("p95"))
    r = lambda c: F.round(c, 1)
    return total.join(p95, by).select(by, F.col("n").alias("count"), r(F.col("total")).alias("total"), r(F.col("total") / F.col("n")).alias("avg"), r(F.col("p95")).alias("p95"), r(F.col("top")).alias("max"))


def span_tree(spark: SparkSession, spans: str) -> DataFrame:
    """run_id, span_id, depth, path of every span of the view that a root leads to, level by level from the roots.

    Each level is a join of the one before with all spans below others, and is written: neither the number of rows nor the depth
    is limited, as both are in a recursive query. Ids are unique within their run.
    """
    rows = stored(spark.table(spans).select("run_id", "span_id", "parent_span_id", F.col("name").cast("string").alias("name")), "spans")
    below = rows.where("parent_span_id is not null").select("run_id", F.col("parent_span_id").alias("span_id"), F.col("span_id").alias("_id"), "name")
    level = stored(rows.where("parent_span_id is null").select("run_id", "span_id", F.lit(0).alias("depth"), F.col("name").alias("path")), "span-level")
    levels = [level]
    while not level.isEmpty():
        path = F.concat("path", F.lit("/"), "name").alias("path")
        level = stored(level.join(below, ["run_id", "span_id"]).select("run_id", F.col("_id").alias("span_id"), (F.col("depth") + 1).alias("depth"), path), "span-level")
        levels.append(level)
    discard(rows)
    return spark.read.schema(levels[0].schema).parquet(*(x._stored_path for x in levels))
