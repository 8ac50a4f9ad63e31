"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a join and a minimum per node, so neither edges nor labels ever meet in one task or the
driver; the number of edges never grows and the number of rounds is logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, few, stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node id reachable.

    Self-loops, repeated edges and nulls are ignored; an empty edge table gives an empty result.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "cc")
    before = _signature(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # edges never grow in number
        last, e = e, stored(few(hop.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), before[0]), "cc")
        discard(last)
        now = _signature(e)
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component"))
