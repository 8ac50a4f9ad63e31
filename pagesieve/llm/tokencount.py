"""Token counts under a unigram vocabulary, by a count-only Viterbi.

An Aho-Corasick automaton enumerates all vocabulary matches of a chunk; dynamic programming carries, for
each character position, the best score and the number of pieces on its path, never the pieces themselves.
Rules are those of the public unigram tokenizers: scores add up as doubles from the start of the chunk;
candidates for one position come in ascending order of their start and only a strictly better score
replaces an earlier one; a character that no single-character piece covers may be an unknown piece at the
smallest vocabulary score minus 10; neighbouring unknown pieces count as one; with byte fallback they count
as their UTF-8 bytes instead.

A text is one chunk per word: blanks become U+2581, one is put in front, and a chunk is a run of blanks
with the characters up to the next blank, as the tokenizers' word splitting has it. Where words are not split and the
vocabulary has pieces with a blank after another character, the whole text is one chunk. Counts of chunks
already seen are remembered per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, mapped

BLANK = "▁"
_UNKNOWN_PENALTY = 10.0
_REMEMBERED = 400_000
_CROSSING = regex.compile(f"[^{BLANK}]{BLANK}")
_SPACE = regex.compile("[ \n\t\r]")


class UnigramCounter:
    """Counts pieces; vocabulary: piece -> score. split_words: whether no piece may cross the start of a word."""

    def __init__(self, vocabulary: dict[str, float], *, byte_fallback: bool = False, split_words: bool = True) -> None:
        self.automaton = ahocorasick.Automaton()
        self.whole = not split_words and any(map(_CROSSING.search, vocabulary))
        for piece, value in vocabulary.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), value))
        self.automaton.make_automaton()
        self.empty = not any(vocabulary)
        self.unknown = min(vocabulary.values(), default=0.0) - _UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.known: dict[str, int] = {}

    def chunk(self, s: str) -> int:
        """Pieces of one chunk on the best path."""
        n = len(s)
        starts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if not self.empty:
            for end, (length, value) in self.automaton.iter(s):
                starts[end + 1 - length].append((end + 1, value))
        best: list[float | None] = [None] * (n + 1)
        pieces, is_unknown = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, single = best[i], False
            for end, value in starts[i]:
                total = value + here
                if best[end] is None or total > best[end]:
                    best[end], pieces[end], is_unknown[end] = total, pieces[i] + 1, False
                single |= end == i + 1
            if not single:
                total = self.unknown + here
                if best[i + 1] is None or total > best[i + 1]:
                    cost = len(s[i].encode("utf-8", "surrogatepass")) if self.byte_fallback else 0 if is_unknown[i] else 1
                    best[i + 1], pieces[i + 1], is_unknown[i + 1] = total, pieces[i] + cost, True
        return pieces[n]

    def count(self, text: str) -> int:
        """Pieces of a text; '' has none."""
        total, known = 0, self.known
        for c in [BLANK + _SPACE.sub(BLANK, text)] if self.whole and text else _chunks(text):
            k = known.get(c)
            if k is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                k = self.chunk(c)
                if len(c) < 64:
                    known[c] = k
            total += k
        return total


def _chunks(text: str) -> list[str]:
    if not text:
        return []
    words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    if "" not in words:
        return [BLANK + w for w in words]
    return regex.findall(f"{BLANK}+[^{BLANK}]*", BLANK + " ".join(words).replace(" ", BLANK))


def zipf_vocabulary(model_file: str) -> dict[str, float]:
    """Unigram scores for the pieces of a SentencePiece file: by Zipf's law, minus the logarithm of the rank.

    Control, unknown and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ranked = dict.fromkeys(pieces)
    return {p: -math.log(rank + 2.7) for rank, p in enumerate(ranked)}


def token_counts(docs: DataFrame, model_file: str, *, byte_fallback: bool = False, split_words: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_chars (code points), n_words for every row; null and empty texts have 0 of each.

    model_file is read on the driver; the vocabulary (some 32,000 pieces) travels with the tasks. Rows
    repeat as given, other columns are ignored, and an empty table gives an empty result.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(zipf_vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(vocabulary.value, byte_fallback=byte_fallback, split_words=split_words)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            arrays = [pa.array([f(t) for t in texts], pa.int64()) for f in (counter.count, len, lambda t: len(t.split()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_tokens", "n_chars", "n_words"])

    return id_text(docs).transform(mapped, run, "doc_id long, n_tokens long, n_chars long, n_words long").select("doc_id", "n_tokens", "n_chars", "n_words", F.when(F.col("n_words") > 0, F.col("n_tokens") / F.col("n_words")).alias("fertility"))
