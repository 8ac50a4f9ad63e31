"""Substring deduplication by line or paragraph hashing.

Texts are cut into units (lines, or paragraphs between blank lines), units are normalised (lower case, white
space collapsed) and hashed with 128 bits, digests are grouped over the whole corpus, the earliest ranked
occurrence (smallest doc_id, then position) stays and every other is removed. Offsets refer to the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name, id_text, mapped, stored

_CUTS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+")}
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def normalise(unit: str) -> str:
    return _SPACE.sub(" ", unit.lower()).strip(" ")


def units_of(text: str, cut: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """(start, end, unit) in code points, separators left out."""
    at = 0
    for m in cut.finditer(text):
        yield at, m.start(), text[at : m.start()]
        at = m.end()
    yield at, len(text), text[at:]


def _units(unit: str, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _CUTS[unit]
        for batch in batches:
            ids, numbers, starts, ends, words, digests = [], [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (s, e, u) in enumerate(units_of(text, cut)):
                    if e - s < 2 * min_words - 1:
                        continue
                    norm = normalise(u)
                    n = norm.count(" ") + 1
                    if n >= min_words and norm:
                        ids.append(i)
                        numbers.append(k)
                        starts.append(s)
                        ends.append(e)
                        words.append(n)
                        digests.append(hashlib.md5(norm.encode("utf-8", "surrogatepass")).digest())
            columns = zip((ids, numbers, starts, ends, words), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in columns), pa.array(digests, pa.binary())], ["doc_id", "unit", "start", "end", "n_words", "digest"])

    return run


def repeated_units(docs: DataFrame, *, unit: str = "line", min_words: int = 8) -> DataFrame:
    """One row per unit to remove: doc_id, unit (its number in the text), start, end, n_words, digest, keep_doc_id, keep_start.

    Units of fewer words are never compared. Rank is (doc_id, start); documents without an id rank last, and copies
    of a row (equal doc_id and start) count as one occurrence, which all of them keep. A text that repeats a unit itself
    loses the later ones. Null and empty texts and empty tables give no rows; other columns are ignored.
    """
    found = stored(id_text(docs).transform(mapped, _units(unit, min_words), "doc_id long, unit long, start long, end long, n_words long, digest binary"), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start")
    # a digest is kept for the join only if it occurs at two places
    first = found.groupBy("digest").agg(F.min(rank).alias("keep"), F.max(rank).alias("other")).where("not (keep <=> other)").select("digest", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"))
    out = found.join(first, "digest").where("not (doc_id <=> keep_doc_id and start = keep_start)")
    return out.select("doc_id", "unit", "start", "end", "n_words", F.lower(F.hex("digest")).alias("digest"), "keep_doc_id", "keep_start")


def without_repeats(docs: DataFrame, *, unit: str = "line", min_words: int = 8) -> DataFrame:
    """docs with the repeated units cut out of text, each with the line break after it, plus removed array<struct<start, end>> in original offsets.

    doc_id has to identify rows; rows without one keep their text. A column named removed is replaced.
    """
    spans = repeated_units(docs, unit=unit, min_words=min_words).where("doc_id is not null").select("doc_id", "start", "end").distinct()
    return cut_out(docs, spans)


def cut_out(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the spans (doc_id, start, end) of their texts, each with the line break after it, and with removed array<struct<start, end>>."""
    spans = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(held := free_name(docs, "spans")))
    joined = docs.drop("removed").join(spans, "doc_id", "left")
    names = [c for c in docs.columns if c != "removed"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out = []
            for text, where in zip(texts, spans, strict=True):
                parts, end = [], 0
                for s in where or []:
                    parts.append(text[end : s["start"]])
                    end = s["end"] + (text[s["end"] : s["end"] + 1] == "\n")
                out.append(text if not end else "".join([*parts, text[end:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)], [*names, "removed"])

    joined = joined.select(*names, F.coalesce(held, F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("removed"))
    return joined.transform(mapped, cut, joined.schema)


def lines_sql(min_words: int) -> str:
    """DuckDB SQL for repeated_units(documents, unit='line')."""
    return f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents),
placed as (
  select doc_id, k - 1 as unit, line,
         coalesce(sum(length(line) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as start,
         trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') as norm from lines),
units as (
  select doc_id, unit, start, start + length(line) as "end", length(norm) - length(replace(norm, ' ', '')) + 1 as n_words, md5(norm) as digest
  from placed where norm <> '' and length(norm) - length(replace(norm, ' ', '')) + 1 >= {min_words}),
ranked as (
  select *, first_value(doc_id) over w as keep_doc_id, first_value(start) over w as keep_start from units
  window w as (partition by digest order by doc_id, start))
select doc_id, unit::bigint as unit, start, "end"::bigint as "end", n_words::bigint as n_words, digest, keep_doc_id, keep_start
from ranked where not (doc_id = keep_doc_id and start = keep_start)"""
