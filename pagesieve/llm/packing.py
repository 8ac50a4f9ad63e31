"""Packing by optimal length buckets.

A global histogram of document lengths goes through dynamic programming, which chooses the bucket bounds that
minimise padding when each document is padded to its bucket's bound. Inside each bucket documents form batches
of as many as fit the token budget, all full but the last.

The histogram holds every distinct length exactly, at any size of the table: tens of thousands of numbers on the
driver. Each bucket is one pass over it, along the lower hull of lines. Places in a bucket are
found without gathering it: documents are dealt into slices by hash, sums over slices give each slice its first
place, and only the few thousand rows of a slice are ordered together.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored
from .mixing import token_count

_SLICE = 4096


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most so many ascending bounds out of lengths (ascending), the last the largest, with the least total of count * bound."""
    m = len(lengths)
    if not m:
        return []
    # whole numbers of any size: products of sums pass 2^53
    xs = [int(x) for x in lengths]
    total = [0, *accumulate(int(n) for n in counts)]
    cost = [t * x for t, x in zip(total[1:], xs, strict=True)]
    choices = []
    for _ in range(min(buckets, m) - 1):
        new, chosen = [], []
        # bucket (i, j]: lengths i+1..j padded to xs[j], cost[i] + (total[j+1] - total[i+1]) * xs[j]; i = -1 is no earlier bucket.
        # As lines in xs[j] slopes fall with i and xs rises with j: the least line only moves on.
        hull, at = [(0, 0, -1)], 0
        for j in range(m):
            while at + 1 < len(hull) and hull[at + 1][0] - hull[at + 1][1] * xs[j] < hull[at][0] - hull[at][1] * xs[j]:
                at += 1
            base, slope, i = hull[at]
            new.append(base + (total[j + 1] - slope) * xs[j])
            chosen.append(i)
            line = (cost[j], total[j + 1], j)
            while len(hull) - at >= 2 and (line[0] - hull[-2][0]) * (hull[-1][1] - hull[-2][1]) <= (hull[-1][0] - hull[-2][0]) * (line[1] - hull[-2][1]):
                hull.pop()
            hull.append(line)
        cost = new
        choices.append(chosen)
    bounds, j = [], m - 1
    for chosen in reversed(choices):
        bounds.append(int(lengths[j]))
        j = chosen[j]
        if j < 0:
            break
    else:
        bounds.append(int(lengths[j]))
    return sorted(bounds)


def packed(docs: DataFrame, *, buckets: int = 16, budget: int = 16384, length: Column | None = None) -> DataFrame:
    """doc_id, length, bucket (from 0), bound, batch (from 0 in its bucket), place (in its batch), padding for every row.

    length: tokens of a row, by default its words. A batch holds max(1, budget // bound) documents, so a longer
    document is a batch of its own. Texts without words (null or empty) have length 0 and pad to their bucket's bound.
    Rows repeat as given, ties go by hash, then doc_id; an empty table gives an empty result; other columns are ignored.
    """
    tokens = length if length is not None else token_count(F.coalesce(docs["text"].cast("string"), F.lit("")))
    rows = stored(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("length")), "pack-lengths")
    histogram = sorted((r.length, r.n) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect())
    bounds = optimal_bounds(np.array([x for x, _ in histogram]), np.array([n for _, n in histogram]), buckets)
    whole = sum(n for _, n in histogram)
    slices = max(1, -(-whole // _SLICE))
    bound = F.lit(bounds[-1] if bounds else 0).cast("long")
    number = F.lit(max(len(bounds) - 1, 0))
    for k in reversed(range(len(bounds) - 1)):
        bound = F.when(F.col("length") <= bounds[k], F.lit(bounds[k]).cast("long")).otherwise(bound)
        number = F.when(F.col("length") <= bounds[k], F.lit(k)).otherwise(number)
    hashed = F.xxhash64("doc_id", "length")
    dealt = rows.withColumns({"bucket": number, "bound": bound, "hash": hashed, "slice": F.pmod(hashed, F.lit(slices))})
    sizes = dealt.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    first = sizes.select("bucket", "slice", (F.sum("n").over(W.partitionBy("bucket").orderBy("slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    placed = dealt.withColumn("at", F.row_number().over(W.partitionBy("bucket", "slice").orderBy("hash", "doc_id")) - 1)
    each = F.greatest(F.lit(1), (F.lit(budget) / F.greatest("bound", F.lit(1))).cast("long"))
    rank = F.col("at") + F.col("first")
    out = placed.join(first, ["bucket", "slice"])
    return out.select("doc_id", "length", F.col("bucket").cast("int").alias("bucket"), "bound", F.floor(rank / each).cast("long").alias("batch"), (rank % each).cast("int").alias("place"), (F.col("bound") - F.col("length")).alias("padding"))
