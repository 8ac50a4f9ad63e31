"""Which pages hold which quotes: a search of all quotes in one pass over the pages, then the exact test on what it finds."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..sources.shared import mapped

#: Most patterns in one automaton; more quotes are looked for block by block.
BLOCK = 200_000


def needle(quote: Column, threshold: float) -> Column:
    """A string that every page with the quote holds, as long as no ellipsis is in it: what all long enough stretches share. quote: stripped, in match form."""
    n = F.length(quote)
    least = F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")
    return F.substring(quote, n - least + 1, F.greatest(2 * least - n, F.lit(1)))


def needles(quotes: DataFrame, threshold: float) -> DataFrame:
    """quote_id, needle: a page holds a quote only if it holds one of its needles: the middle, or the longest piece beside an ellipsis."""
    q = quotes.where(F.length("q") >= 8)
    middle = q.select("quote_id", needle(F.col("q"), threshold).alias("needle"))
    pieces = F.filter(tx.quote_pieces(F.col("q")), lambda p: F.length(p) >= 20)
    longest = q.select("quote_id", F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p), p.alias("p"))))["p"].alias("needle"))
    return middle.unionAll(longest).where("needle <> ''").distinct()


def found(quotes: DataFrame, pages: DataFrame, threshold: float = 0.85, block: int = BLOCK) -> DataFrame:
    """quote_id, doc_id of each quote (quote_id, quote) that stands on a page (doc_id, text), as text.quote_on_page() says.

    The quotes' needles go to the tasks as automata of at most `block` patterns each; pages stream through them and only
    pairs that hold a needle are tested. Pages are read once per block of quotes.
    """
    spark = pages.sparkSession
    forms = quotes.select("quote_id", tx.stripped_quote(tx.match_form(F.col("quote"))).alias("q"))
    texts = pages.select("doc_id", tx.match_form(F.col("text")).alias("page"))
    wanted = needles(forms, threshold)
    blocks = max(1, -(-wanted.count() // block))
    out = None
    for k in range(blocks):
        # bounded: about `block` patterns
        mine = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("quote_id"), F.lit(blocks)) == k)
        rows: dict[str, list[int]] = {}
        for r in mine.collect():
            rows.setdefault(r.needle, []).append(r.quote_id)
        shared = spark.sparkContext.broadcast(rows)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for pattern, ids in shared.value.items():
                automaton.add_word(pattern, ids)
            automaton.make_automaton()
            for batch in batches:
                # a page's text leaves once, with the numbers of its quotes
                hits = [sorted({i for _, ids in automaton.iter(page.as_py() or "") for i in ids}) if len(automaton) else [] for page in batch.column(1)]
                out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "page", "quotes"])
                yield out.filter(pa.array([bool(x) for x in hits], pa.bool_()))

        some = mapped(texts, search, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, page string, quotes array<long>")
        pairs = some.select("doc_id", "page", F.explode("quotes").alias("quote_id"))
        out = pairs if out is None else out.unionAll(pairs)
    return out.join(forms, "quote_id").where(tx.quote_on_page(F.col("q"), F.col("page"), threshold)).select("quote_id", "doc_id")
