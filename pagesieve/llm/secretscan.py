"""Secret scan by token efficiency.

Three pattern kinds (assigned values, access keys, hexadecimal strings) are found first. The method adds a
fourth: runs of key characters whose text needs many tokens under a byte-pair vocabulary, that is,
whose characters per token are low, as for random strings; prose and code words need few. Judged are maximal runs
and, inside them, the shortest sequences of separated parts of 16 characters and more that begin or end with each
part; what is found is joined, so that a path or name in front hides no key. Known digests
(32, 40, 56, 64, 96 or 128 hexadecimal digits) and identifiers (UUIDs, dates, numbers, words joined by
separators or case) are excluded, and runs are cut where a base span covers them already.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .common import id_text, mapped

# The base patterns with the least length of the measured group, in order of kind.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SHORTEST = 16
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_PART = re.compile(r"[A-Za-z0-9]+")
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])")
_IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/+=]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[-_/+=]*\Z")
_CAMEL = re.compile(r"[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})+[0-9]{0,4}\Z")


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """Spans of the three base kinds, by start, then kind."""
    out = []
    low = text.lower()
    # words with letters that only lower() maps to ASCII do no harm: this is a cheap first look
    if any(k in low for k in _KEYWORDS):
        out += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)



# Fixed value: splits into letters, digits and other signs with a leading blank, as byte-pair vocabularies of this kind expect.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def excluded(run: str) -> bool:
    """Known digests and identifiers."""
    if len(run) in _DIGEST_LENGTHS and _DIGEST.match(run):
        return True
    return bool(_UUID.match(run) or _IDENTIFIER.match(run) or _CAMEL.match(run))


def _windows(run: str, shortest: int) -> set[tuple[int, int]]:
    """The run, and for each of its parts between separators the shortest sequences of parts from it and up to it that are long enough."""
    parts = [m.span() for m in _PART.finditer(run)]
    out = {(0, len(run))}
    to = back = 0
    for k, (start, end) in enumerate(parts):
        to = max(to, k)
        while to < len(parts) and parts[to][1] - start < shortest:
            to += 1
        if to < len(parts):
            out.add((start, parts[to][1]))
        while back < k and end - parts[back + 1][0] >= shortest:
            back += 1
        if end - parts[back][0] >= shortest:
            out.add((parts[back][0], end))
    return out


def _free(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What taken leaves of start to end."""
    for s, e in sorted(taken):
        if s < end and start < e:
            if start < s:
                yield start, s
            start = max(start, e)
    if start < end:
        yield start, end


def random_spans(text: str, base: list[Span], enc: tiktoken.Encoding, ratio: float, seen: dict[str, bool], shortest: int = SHORTEST) -> list[Span]:
    """Joined windows of so many key characters and more with letters and digits, or both cases, at most ratio characters per token, outside base spans."""

    def judged(run: str) -> bool:
        verdict = seen.get(run)
        if verdict is None:
            mixed = any(c.isdigit() for c in run) + any(c.islower() for c in run) + any(c.isupper() for c in run) >= 2
            verdict = mixed and not excluded(run) and len(run) <= ratio * len(enc.encode_ordinary(run))
            if len(seen) > 100_000:
                seen.clear()
            if len(run) <= 256:
                seen[run] = verdict
        return verdict

    out: list[Span] = []
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{shortest},}}", text):
        taken = [(s.start, s.end) for s in base if s.start < m.end() and m.start() < s.end]
        taken += [(m.start() + k.start(), m.start() + k.end()) for k in _KNOWN.finditer(m[0]) if excluded(k[0])]
        for start, end in _free(m.start(), m.end(), taken):
            run = text[start:end]
            if end - start < shortest or excluded(run):
                continue
            last = -1
            for s, e in sorted(_windows(run, shortest)):
                if judged(run[s:e]):
                    if s < last:
                        last = max(last, e)
                        out[-1] = Span(out[-1].start, 3, start + last)
                    else:
                        out.append(Span(start + s, 3, start + e))
                        last = e
    return out


def _find(vocabulary: tuple, ratio: float, shortest: int):
    ranks, pattern = vocabulary
    enc = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
    seen: dict[str, bool] = {}

    def spans(text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        return base, sorted(base + random_spans(text, base, enc, ratio, seen, shortest))

    return spans


def _vocabulary(docs: DataFrame, vocabulary_file: str) -> tuple:
    """The vocabulary file (some 50,000 entries, under 1 MB) is read on the driver and travels with the tasks."""
    with open(vocabulary_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return docs.sparkSession.sparkContext.broadcast(ranks), PATTERN


def scan(docs: DataFrame, vocabulary_file: str, *, ratio: float = 2.2, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for every row.

    Added spans are runs of letters, digits and + / _ = - of at least ``shortest`` characters (a dot or any other sign ends
    a run: it joins words in prose and names) with at most ``ratio`` characters per token. Shorter strings are not told from
    words by this test. Positions count code points, ends are exclusive. Null and empty texts have no spans (empty string, and its
    sha256). Rows repeat as given, other columns are ignored, and an empty table gives an empty result.
    """
    vocabulary = _vocabulary(docs, vocabulary_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _find(vocabulary, ratio, shortest)
        for batch in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for text in batch.column(1).to_pylist():
                base, found = find(text)
                for k in range(4):
                    counts[k].append(sum(s.kind == k for s in found))
                digests.append(hashlib.sha256(",".join(map(str, base)).encode()).hexdigest())
                spans.append(",".join(map(str, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return id_text(docs).transform(mapped, run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(docs: DataFrame, vocabulary_file: str, *, ratio: float = 2.2, shortest: int = SHORTEST, mark: str = "[secret]") -> DataFrame:
    """docs with each secret span of text replaced by mark (overlapping spans by one); all other columns and rows as given.

    Of an assigned value the whole match goes. Null texts stay null.
    """
    vocabulary = _vocabulary(docs, vocabulary_file)
    at = docs.columns.index("text")

    def clean(text: str | None, find) -> str | None:
        if text is None:
            return None
        out, end = [], 0
        for s in find(text)[1]:
            if s.start >= end:
                out += [text[end : s.start], mark]
            end = max(end, s.end)
        return "".join([*out, text[end:]]) if end else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _find(vocabulary, ratio, shortest)
        for batch in batches:
            texts = pa.array([clean(t, find) for t in batch.column(at).to_pylist()], pa.string())
            columns = [texts if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    kinds = dict(docs.dtypes)
    if kinds["text"] != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.transform(mapped, run, docs.schema)
