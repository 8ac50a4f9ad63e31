"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

Each weighted term (word with its frequency) draws, per sample, gamma and uniform variates seeded by the term
alone; the sample is the term with the smallest ratio and its quantised weight. Two fingerprints agree in a
sample with probability sum(min(w)) / sum(max(w)), the generalised Jaccard similarity of the term weights.

Draws for (term, weight) pairs already seen are remembered per task, so a text costs one gather and one
minimum per distinct term.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import id_text, mapped

SAMPLES = 64
_SLOTS = 120_000
_TOGETHER = 64


def _uniforms(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform floats in (0, 1) from each 64-bit seed (splitmix64)."""
    z = seed + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z = z ^ (z >> np.uint64(31))
    halves = (z & np.uint64(0xFFFFFFFF)), z >> np.uint64(32)
    return tuple(np.minimum((h.astype(np.float32) + np.float32(0.5)) * np.float32(2**-32), np.float32(1 - 2**-24)) for h in halves)


class Sampler:
    """Fingerprints of weighted term sets.

    A slot holds, per sample, one integer: the ratio of a (term, weight) pair as an ordered integer above 16
    bits of hash of the term and its quantised weight. The least integer per sample is the sample.
    """

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples = samples
        self.slots: dict[bytes | tuple[bytes, int], int] = {}
        # pages that are never written take no memory
        self.keys = np.empty((_SLOTS, samples), np.int64)
        self.streams = np.arange(1, 3 * samples + 1, dtype=np.uint64).reshape(3, samples) * np.uint64(0xD1342543DE82EF95)

    def _draw(self, pairs: list[bytes | tuple[bytes, int]]) -> None:
        for at in range(0, len(pairs), 256):
            part = pairs[at : at + 256]
            split = [(p, 1) if isinstance(p, bytes) else p for p in part]
            term = np.array([xxhash.xxh3_64_intdigest(t) for t, _ in split], np.uint64)[:, None]
            log_w = np.log(np.array([w for _, w in split], np.float32))[:, None]
            (u1, u2), (u3, u4), (beta, _) = (_uniforms(term ^ stream) for stream in self.streams)
            r, log_c = -np.log(u1 * u2), np.log(-np.log(u3 * u4))
            t = np.floor(log_w / r + beta)
            # ln a = ln c - ln y - r, with ln y = r (t - beta)
            order = (log_c - r * (t - beta + 1)).view(np.int32)
            order = order ^ ((order >> 31) & np.int32(0x7FFFFFFF))
            tag = (term + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(48)
            n = len(self.slots)
            self.keys[n : n + len(part)] = (order.astype(np.int64) << 16) | tag.astype(np.int64)
            self.slots.update((p, n + i) for i, p in enumerate(part))

    def fingerprint(self, weights: dict[bytes, int]) -> np.ndarray | None:
        return self.fingerprints([weights])[0]

    def fingerprints(self, sets: list[dict[bytes, int]]) -> list[np.ndarray | None]:
        """16-bit hashes of the sampled (term, quantised weight) pairs of each set; None for no terms. Draws are made for many sets at once."""
        keyed = [[t if w == 1 else (t, w) for t, w in weights.items()] for weights in sets]
        out: list[np.ndarray | None] = []
        at = 0
        while at < len(keyed):
            # as many sets as the slots hold together; a larger set goes alone, in blocks
            upto, n = at, 0
            while upto < len(keyed) and (upto == at or n + len(keyed[upto]) <= _SLOTS):
                n += len(keyed[upto])
                upto += 1
            if upto == at + 1:
                out.append(self._blocks(keyed[at]))
            else:
                self._ensure([p for pairs in keyed[at:upto] for p in pairs])
                get = self.slots.get
                out += [(self.keys[list(map(get, pairs))].min(0) & 0xFFFF).astype(np.uint16) if pairs else None for pairs in keyed[at:upto]]
            at = upto
        return out

    def _ensure(self, pairs: list) -> None:
        new = list(dict.fromkeys(p for p in pairs if p not in self.slots))
        if len(self.slots) + len(new) > _SLOTS:
            self.slots.clear()
            new = list(dict.fromkeys(pairs))
        self._draw(new)

    def _blocks(self, pairs: list) -> np.ndarray | None:
        least = None
        for i in range(0, len(pairs), _SLOTS):
            block = pairs[i : i + _SLOTS]
            self._ensure(block)
            low = self.keys[list(map(self.slots.get, block))].min(0)
            least = low if least is None else np.minimum(least, low)
        return None if least is None else (least & 0xFFFF).astype(np.uint16)


def terms(text: str) -> Counter:
    """Words of the text, A-Z in lower case, with their frequencies."""
    return Counter(text.encode("utf-8", "surrogatepass").lower().split())


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal samples: an estimate of generalised Jaccard similarity. Two texts without terms are alike, one is unlike any other."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def hexed(f: np.ndarray | None) -> str:
    return "" if f is None else f.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """doc_id, fingerprint (hexadecimal, 4 digits per sample; '' for texts without words) for every row.

    Null texts are empty; rows repeat as given; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sampler(samples)
        for batch in batches:
            for part in (batch.slice(i, _TOGETHER) for i in range(0, batch.num_rows, _TOGETHER)):
                found = s.fingerprints([terms(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(hexed, found), pa.string())], ["doc_id", "fingerprint"])

    return id_text(docs).transform(mapped, run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many, or all, of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compared_with_edits(docs: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the next row by doc_id, null ids first, equal ids by a hash of their text, then by text; after
    the last comes the first. A table of one row is followed by itself. Null and empty texts have the empty
    fingerprint; an empty table gives an empty result; other columns are ignored.

    Rows move once, compressed, into consecutive blocks of doc_id (bounds are approximate quantiles, two numbers per
    block on the driver; copies of the first row of a block also go to the end of the one before), where a
    task streams through them in order. An id that fills several blocks is shared out over them by hash.
    """
    spark = docs.sparkSession
    base = id_text(docs)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = 8 * max(partitions, spark.sparkContext.defaultParallelism)
    ids = base.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"))
    found = ids.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], max(1000, 20 * blocks))).first()[0] or []
    cuts = np.array(sorted(found), np.int64)
    kept, times = np.unique(cuts, return_counts=True)
    # a quantile that occurs twice may be chance: the id is few rows; three times it fills a block
    cuts = np.repeat(kept, np.where(times > 2, times, 1))
    shared = bool((times > 2).any())
    rows = base if shared else base.select("doc_id", F.lit("").alias("text"))
    firsts = rows.transform(mapped, _blocked(cuts), "block int, doc_id long, hash long").groupBy("block").agg(F.min(F.struct("doc_id", "hash")).alias("first")).orderBy("block").collect()
    ahead = {(r.first.doc_id, r.first.hash if shared else None): (r.block, firsts[i - 1].block) for i, r in enumerate(firsts)}
    dealt = base.transform(mapped, _zipped(cuts, ahead, shared), "doc_id long, packed binary, block int, extra boolean, hash long")
    dealt = dealt.repartition(partitions, "block").sortWithinPartitions("block", "extra", F.col("doc_id").asc_nulls_first(), "hash", "packed").select("doc_id", "packed", "block", "extra")
    return dealt.transform(mapped, _walk(samples), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_NULL = -(1 << 63)


def _placed(batch: pa.RecordBatch, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (null as the least), hashes of the texts, and blocks: the number of cuts below an id, and for an id that is a cut m times one of m blocks by hash."""
    ids = batch.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()), np.uint64, len(ids))
    low, high = np.searchsorted(cuts, ids), np.searchsorted(cuts, ids, side="right")
    share = ((hashes >> np.uint64(32)) * np.maximum(high - low, 1).astype(np.uint64)) >> np.uint64(32)
    return ids, (hashes >> np.uint64(1)).astype(np.int64), (low + share.astype(np.int64)).astype(np.int32)


def _blocked(cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, block = _placed(batch, cuts)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(ids), pa.array(hashes)], ["block", "doc_id", "hash"])

    return run


def _zipped(cuts: np.ndarray, ahead: dict, shared: bool):
    """Rows with their block; those that are first in a block a second time, as extra rows of the block before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, hashes, block = (x.tolist() for x in _placed(batch, cuts))
            packed = [z.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            more = []
            for k, (i, h, b) in enumerate(zip(ids, hashes, block, strict=True)):
                at = ahead.get((i, h if shared else None))
                if at is not None and at[0] == b:
                    more.append((k, at[1]))
            rows = [*range(len(ids)), *(k for k, _ in more)]
            take = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(take), pa.array([packed[k] for k in rows], pa.binary()), pa.array([*block, *(b for _, b in more)], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([False] * len(ids) + [True] * len(more)), pa.array([hashes[k] for k in rows], pa.int64())], ["doc_id", "packed", "block", "extra", "hash"])

    return run


def _walk(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, unzip = Sampler(samples), zstandard.ZstdDecompressor()
        held: tuple | None = None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        for batch in batches:
            for part in (batch.slice(i, _TOGETHER) for i in range(0, batch.num_rows, _TOGETHER)):
                rows = list(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True))
                texts = [unzip.decompress(packed).decode("utf-8", "surrogatepass") for _, packed, _, _ in rows]
                pairs, last = [], held
                for k, (_, _, block, extra) in enumerate(rows):
                    follows = last is not None and last[1] == block
                    if follows:
                        pairs.append((k, last[0], edited(last[2], texts[k])))
                    if not extra or follows:
                        # of equal first rows of a block only one follows the block before
                        last = None if extra else (k, block, texts[k])
                found = s.fingerprints([terms(t) for t in texts] + [terms(e) for _, _, e in pairs])
                out = []
                for (k, before, e), g in zip(pairs, found[len(rows) :], strict=True):
                    i, text, f = (held[3], held[2], held[4]) if before == -1 else (rows[before][0], texts[before], found[before])
                    out.append((i, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), hexed(f), hexed(g), likeness(f, g), likeness(f, found[k])))
                if last is None or last[0] >= 0:
                    held = None if last is None else (-1, last[1], last[2], rows[last[0]][0], found[last[0]])
                columns = zip(*out, strict=True) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run
