"""Passages that repeat anywhere in the corpus, whatever lines they stand in.

Units are all runs of ``words`` words (lower case, any white space between them). Their digests are grouped over the
whole corpus, the earliest ranked place (doc_id, start) stays, every other is removed, and overlapping ones join to
maximal passages with original offsets.

Not every run has to travel. A run's least digest of shorter word groups (winnowing) is the same wherever it
stands, so that only runs whose least digest occurs twice can repeat. Runs in a row that share a least digest are a
stretch; places whose stretches are equal form a class, and all but the earliest place of a class repeat it as a
whole. Only that earliest one is compared run by run, by 128-bit digests, with the other classes of its least digest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import id_text, mapped

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_REMEMBERED = 100_000
_BLOCK = 200_000


class _Digests(dict):
    """64-bit digests of words, remembered up to a fixed number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class _Powers:
    """Powers of the factors and of their inverses modulo 2^64, as many as the longest text needed."""

    def __init__(self) -> None:
        self.up, self.down = [np.ones(1, np.uint64)] * 2, [np.ones(1, np.uint64)] * 2

    def at_least(self, n: int) -> None:
        if n > len(self.up[0]):
            n = max(n, 2 * len(self.up[0]))
            one = np.ones(1, np.uint64)
            grown = lambda f: np.concatenate([one, np.cumprod(np.full(n - 1, f, np.uint64))])
            self.up, self.down = [grown(f) for f in _FACTORS], [grown(pow(f, -1, 1 << 64)) for f in _FACTORS]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Text:
    """The words of a text: digests of any run of them, and the stretches of runs that share a least digest."""

    def __init__(self, text: str, words: int, known: _Digests, powers: _Powers) -> None:
        found = text.lower().encode("utf-8", "surrogatepass").split()
        self.n, self.words = len(found), words
        if self.n < words:
            return
        h = np.fromiter(map(known.__getitem__, found), np.uint64, self.n)
        powers.at_least(self.n)
        self.powers = powers
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[: self.n])]) for p in powers.up]
        # groups of size words, the least of span of them: size + span - 1 = words
        span = 1 << max((2 * words // 3).bit_length() - 1, 0)
        size = words - span + 1
        self.groups = _mixed(self.digest(0, np.arange(self.n - size + 1), np.arange(size, self.n + 1)))
        least, step = self.groups, 1
        while step < span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
        #: stretch k: runs first[k] to last[k] inclusive have the least digest least[k]
        self.first, self.last = np.r_[0, cuts], np.r_[cuts - 1, len(least) - 1]
        self.least = least[self.first]

    def digest(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return (s[end] - s[start]) * self.powers.down[which][start]

    def places(self) -> np.ndarray:
        """For each stretch, how many groups of the text have its least digest."""
        values, counts = np.unique(self.groups, return_counts=True)
        return counts[np.searchsorted(values, self.least)]


def _row(text: str) -> int:
    """Tells texts under one doc_id apart."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_CLASSES = "least long, whole long, n long, many boolean, rep struct<last: boolean, doc_id: bigint, row: bigint>, docs array<struct<doc_id: bigint, row: bigint>>"
_RUNS = "doc_id long, row long, start long, end long, until long, a long, b long, copies array<struct<doc_id: bigint, row: bigint, start: bigint, until: bigint>>"


def _lists(offsets: np.ndarray, columns: dict[str, pa.Array]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _least(words: int):
    """Places by class: what half of the texts share is a row per batch, with the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, powers = _Digests(), _Powers()
        for batch in batches:
            ids, rows, least, whole, many = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = Text(text, words, known, powers)
                if t.n >= words:
                    ids += [i] * len(t.least)
                    rows += [_row(text)] * len(t.least)
                    least.append(t.least.view(np.int64))
                    whole.append(t.digest(1, t.first, t.last + words).view(np.int64))
                    many.append(t.places() > 1)
            if ids:
                yield _classes(ids, rows, *map(np.concatenate, (least, whole, many)))

    return run


def _classes(ids: list, rows: list, least: np.ndarray, whole: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    ids_, rows_ = pa.array(ids, pa.int64()), pa.array(rows, pa.int64())
    missing, number = ids_.is_null().to_numpy(zero_copy_only=False), ids_.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((rows_.to_numpy(), number, missing, whole, least))
    least, whole, many = least[order], whole[order], many[order]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])])
    ends = np.r_[new, len(least)]
    ids_, rows_ = ids_.take(pa.array(order)), rows_.take(pa.array(order))
    at = pa.array(new)
    # nulls stand last in their class
    rep = pa.StructArray.from_arrays([pa.array(missing[order][new]), ids_.take(at), rows_.take(at)], ["last", "doc_id", "row"])
    columns = [pa.array(least[new]), pa.array(whole[new]), pa.array(np.diff(ends)), pa.array(np.logical_or.reduceat(many, new)), rep, _lists(ends, {"doc_id": ids_, "row": rows_})]
    return pa.RecordBatch.from_arrays(columns, ["least", "whole", "n", "many", "rep", "docs"])


def _zipped(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            kept = [(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(t.split()) >= words]
            blobs = [z.compress(t.encode("utf-8", "surrogatepass")) for _, t in kept]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int64()), pa.array([_row(t) for _, t in kept], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "row", "blob"])

    return run


def _runs(words: int):
    """Runs to compare: one by one, or the first of a stretch that is repeated as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, powers, unzip = _Digests(), _Powers(), zstandard.ZstdDecompressor()
        for batch in batches:
            parts, held = [], 0
            for i, row, blob, dense, once in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                text = unzip.decompress(blob).decode("utf-8", "surrogatepass")
                t = Text(text, words, known, powers)
                if t.n < words:
                    continue
                every = np.isin(t.least, np.array(dense, np.int64).view(np.uint64)) if dense is not None else np.ones(len(t.least), bool)
                one = np.isin(t.least, np.array(once or [], np.int64).view(np.uint64)) & ~every
                at = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
                spread = [np.arange(s, e + 1) for s, e in zip(t.first[every].tolist(), t.last[every].tolist(), strict=True)]
                spread = np.concatenate([*spread, np.zeros(0, np.int64)]).astype(np.int64)
                first, last = np.concatenate([spread, t.first[one]]), np.concatenate([spread, t.last[one]])
                if len(first):
                    end, n = first + words, len(first)
                    parts.append(([i] * n, np.full(n, row), at[first, 0], at[end - 1, 1], at[last + words - 1, 1], t.digest(0, first, end).view(np.int64), t.digest(1, first, end).view(np.int64)))
                    held += n
                if held >= _BLOCK:
                    yield _run_rows(parts)
                    parts, held = [], 0
            if held:
                yield _run_rows(parts)

    return run


_RUN_NAMES = ["doc_id", "row", "start", "end", "until", "a", "b", "copies"]


def _run_rows(parts: list[tuple]) -> pa.RecordBatch:
    """One row per digest; where several runs have it, their places are in copies, the earliest in the row itself."""
    ids = pa.array([i for x in parts for i in x[0]], pa.int64())
    row, start, end, until, a, b = (np.concatenate([x[k] for x in parts]) for k in range(1, 7))
    missing, number = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((start, row, number, missing, b, a))
    ids = ids.take(pa.array(order))
    row, start, end, until, a, b = (x[order] for x in (row, start, end, until, a, b))
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    sizes = np.diff(np.r_[new, len(a)])
    listed = np.repeat(sizes > 1, sizes)
    at = pa.array(np.flatnonzero(listed))
    places = pa.StructArray.from_arrays([ids.take(at), *(pa.array(x[listed]) for x in (row, start, until))], ["doc_id", "row", "start", "until"])
    offsets = np.r_[0, np.cumsum(np.where(sizes > 1, sizes, 0))]
    copies = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), places, mask=pa.array(sizes == 1))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(new)), *(pa.array(x[new]) for x in (row, start, end, until, a, b)), copies], _RUN_NAMES)


def repeated_passages(docs: DataFrame, *, words: int = 50) -> DataFrame:
    """One row per passage to remove: doc_id, start, end (code points of the original text), keep_doc_id, keep_start (where its first run stays).

    Rank is (doc_id, start); documents without an id rank last, and copies of a row (equal doc_id and text) count as one,
    which all of them keep. Within a text a repeat has to begin after the run that stays. Texts of fewer words, null
    and empty texts and empty tables give no rows; other columns are ignored.
    """
    texts = id_text(docs)
    # a stretch that many texts share comes as a row per batch of texts, not per text
    found = texts.transform(mapped, _least(words), _CLASSES)
    stretch, same = W.partitionBy("least", "whole"), W.partitionBy("least")
    rep = F.min("rep").over(stretch)
    seen = {"rep": rep, "total": F.sum("n").over(same), "any_many": F.max("many").over(same), "low": F.min("whole").over(same), "high": F.max("whole").over(same), "unnamed": F.max(F.exists("docs", lambda d: d["doc_id"].isNull())).over(same)}
    found = found.repartition("least").withColumns(seen).where("total > 1 or any_many")
    at = found.select("least", "rep", "any_many", F.expr("low <> high or unnamed").alias("apart"), F.explode("docs").alias("d")).where("d.doc_id is not null")
    dense = F.expr("any_many or (apart and d.doc_id = rep.doc_id and d.row = rep.row)")
    lists = at.groupBy("d.doc_id", "d.row").agg(F.collect_set(F.when(dense, F.col("least"))).alias("dense"), F.collect_set(F.when(~dense, F.col("least"))).alias("once"))
    packed = texts.transform(mapped, _zipped(words), "doc_id long, row long, blob binary")
    # rows without an id cannot be looked up: all their runs are compared, and so are those of others like them
    none = F.lit(None).cast("array<bigint>")
    unnamed = packed.where("doc_id is null").select("doc_id", "row", "blob", none.alias("dense"), none.alias("once"))
    asked = packed.join(lists, ["doc_id", "row"]).select("doc_id", "row", "blob", "dense", "once").unionAll(unnamed)
    runs = asked.transform(mapped, _runs(words), _RUNS)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start", "end")
    runs = runs.withColumn("keep", F.min(place).over(W.partitionBy("a", "b")))
    own = F.array(F.struct("doc_id", "row", "start", "until"))
    again = runs.select("keep", F.explode(F.coalesce("copies", own)).alias("x")).select("x.*", "keep")
    again = again.where("not (doc_id <=> keep.doc_id and row = keep.row) or start >= keep.end")
    again = again.select("doc_id", "row", "start", "until", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"))
    order = W.partitionBy("doc_id", "row").orderBy("start", "until")
    opened = F.coalesce(F.col("start") >= F.max("until").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    again = again.withColumn("opened", opened.cast("int")).withColumn("passage", F.sum("opened").over(order.rowsBetween(W.unboundedPreceding, 0)))
    first = F.min_by(F.struct("keep_doc_id", "keep_start"), F.struct("start", "until")).alias("keep")
    out = again.groupBy("doc_id", "row", "passage").agg(F.min("start").alias("start"), F.max("until").alias("end"), first)
    return out.select("doc_id", "start", "end", "keep.keep_doc_id", "keep.keep_start")


def without_passages(docs: DataFrame, *, words: int = 50) -> DataFrame:
    """docs with the repeated passages cut out of text, plus removed array<struct<start, end>> in original offsets.

    doc_id has to identify rows; rows without one keep their text. A column named removed is replaced.
    """
    from .linededup import cut_out

    spans = repeated_passages(docs, words=words).where("doc_id is not null").select("doc_id", "start", "end").distinct()
    return cut_out(docs, spans)


def passages_sql(words: int) -> str:
    """DuckDB SQL for repeated_passages(documents): all runs by their digest, the earliest place first, islands of the rest."""
    return f"""
with cut as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as parts from documents),
tokens as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as k from cut),
placed as (select doc_id, part, k, sum(length(part)) over (partition by doc_id order by k) as e from tokens),
listed as (
  select doc_id, list(lower(part) order by k) as ws, list(e - length(part) order by k) as starts, list(e order by k) as ends
  from placed where not regexp_matches(part, '[\x20\x09-\x0D]') group by doc_id),
runs as (
  select doc_id, starts[i]::bigint as s, ends[i + {words - 1}]::bigint as e, md5(array_to_string(ws[i:i + {words - 1}], ' ')) as digest
  from (select *, unnest(range(1, len(ws) - {words - 2})) as i from listed where len(ws) >= {words})),
ranked as (
  select *, first_value(doc_id) over w as keep_doc_id, first_value(s) over w as keep_start, first_value(e) over w as keep_end
  from runs window w as (partition by digest order by doc_id, s)),
again as (select * from ranked where doc_id <> keep_doc_id or s >= keep_end),
marked as (
  select *, case when s < max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as opened from again),
grouped as (select *, sum(opened) over (partition by doc_id order by s, e rows unbounded preceding) as passage from marked)
select doc_id, min(s) as start, max(e) as "end", arg_min(keep_doc_id, s) as keep_doc_id, arg_min(keep_start, s) as keep_start
from grouped group by doc_id, passage"""
