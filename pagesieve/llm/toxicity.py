"""Toxicity by compression distance.

Two zstandard dictionaries of equal size are trained on labelled text: one on toxic, one on ordinary
documents. A window (one word between blanks, framed so that the compressor can always match it) is
compressed with both; the bytes saved by the toxic dictionary are its advantage. A document's largest
advantages and their sum go through a logistic calibration fitted on other labelled documents, whose cut
is shifted so that a score of 0.3 separates best.

Dictionary content is picked by contrast. Of all 6-byte strings inside words, those are kept whose support
(the smaller of document count and distinct surroundings, so that copies count once) is significantly more
frequent in toxic text, by a factor chosen from FACTORS by cross-validated loss on the calibration documents (a
part of the training rows; held-out rows take no part). Their maximal runs, most frequent last, are the toxic
dictionary. The ordinary one holds the most frequent words of ordinary text, to the same length.

Training uses a bounded sample: the ``max_toxic`` and ``max_ordinary`` labelled documents of smallest hash.
Scoring covers every word of every text; results of words already seen are remembered per task.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as z
from pyspark.sql import DataFrame, functions as F

from .common import id_text, mapped

K = 6
CUT = 0.3
FACTORS = (20, 8, 4, 2)
_FRAME = (b"\x01<|window|>\x02", b"\x01\x02\x03\x04\x05\x06\x07\x08")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_REMEMBERED = 300_000


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


def normalised(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and every ASCII byte but letters blank."""
    return b" " + text.encode("utf-8", "replace").translate(_TABLE) + b" "


def _grams(b: bytes) -> np.ndarray:
    a = np.frombuffer(b, np.uint8).astype(np.uint64)
    n = len(a) - K + 1
    v = np.zeros(max(n, 0), np.uint64)
    for j in range(K if n > 0 else 0):
        v = (v << np.uint64(8)) | a[j : j + n]
    return v


def _inside_words(b: bytes, n: int) -> np.ndarray:
    blank = np.frombuffer(b, np.uint8) == 32
    inner = np.zeros(n, bool)
    for j in range(1, K - 1):
        inner |= blank[j : j + n]
    return ~inner


def _support(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    grams, around = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for t in texts:
        b = normalised(t)
        v = _grams(b)
        pad = np.concatenate([np.zeros(K, np.uint64), v, np.zeros(K, np.uint64)])
        c = (pad[: len(v)] * np.uint64(0x9E3779B97F4A7C15)) ^ (pad[2 * K :] * np.uint64(0x165667B19E3779F9))
        ok = _inside_words(b, len(v))
        u, i = np.unique(v[ok], return_index=True)
        grams.append(u)
        around.append(c[ok][i])
    g, c = np.concatenate(grams), np.concatenate(around)
    order = np.lexsort((c, g))
    g, c = g[order], c[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    return np.unique(g[new], return_counts=True)


def train_dictionaries(toxic: list[str], ordinary: list[str], size: int = 8192, factor: float = 8) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary contents of equal length."""
    toxic, ordinary = sorted(set(filter(None, toxic))), sorted(set(filter(None, ordinary)))
    (tg, tn), (og, on) = _support(toxic), _support(ordinary)
    nt, no = max(len(toxic), 1), max(len(ordinary), 1)
    t = np.minimum(tn, nt).astype(float)
    o = np.zeros(len(tg))
    if len(og):
        at = np.minimum(np.searchsorted(og, tg), len(og) - 1)
        o = np.where(og[at] == tg, np.minimum(on[at], no), 0).astype(float)
    p = (t + o) / (nt + no)
    g2 = 2 * (t * np.log(t / nt / p) + np.where(o > 0, o * np.log(np.maximum(o, 1) / no / p), 0))
    chosen = tg[(g2 > 1.3 * math.log(len(tg) + len(og) + 2)) & (t / nt >= factor * o / no)]
    runs: Counter[bytes] = Counter()
    for text in toxic:
        b = normalised(text)
        hit = np.flatnonzero(np.isin(_grams(b), chosen))
        if len(hit):
            gap = np.flatnonzero(np.diff(hit) > 1)
            starts, ends = np.r_[hit[0], hit[gap + 1]].tolist(), (np.r_[hit[gap], hit[-1]] + K).tolist()
            runs.update({b[s:e] for s, e in zip(starts, ends, strict=True)})
    content = b""
    for run, _ in sorted(runs.items(), key=lambda x: (-x[1], x[0])):
        if run not in content and len(content) + len(run) <= size:
            content = run + content
    common = Counter(w for text in ordinary for w in set(normalised(text).split()) if len(w) >= K - 1)
    plain = b""
    for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])):
        if len(plain) >= len(content):
            break
        plain = b" " + w + b" " + plain
    width = max(len(content), 64)
    return content.rjust(width, b"\x03"), plain[:width].rjust(width, b"\x03")


class Windows:
    """Compression advantages of words, remembered up to a fixed number of them."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        params = z.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=4, min_match=5, target_length=24, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(content: bytes) -> z.ZstdCompressor:
            d = z.ZstdCompressionDict(content + _FRAME[0], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            return z.ZstdCompressor(dict_data=d, compression_params=params)

        self.pair = compressor(ordinary), compressor(toxic)
        self.known: dict[bytes, int] = {}

    def _measure(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            framed = [_FRAME[0] + b" " + w + b" " + _FRAME[1] for w in part]
            length = np.array([len(x) for x in framed], np.uint64)
            segments = np.stack([np.concatenate([[np.uint64(0)], np.cumsum(length)[:-1]]).astype(np.uint64), length], 1)
            data = z.BufferWithSegments(b"".join(framed), segments.tobytes())
            plain, toxic = (c.multi_compress_to_buffer(data, threads=1) for c in self.pair)
            self.known.update((w, len(a) - len(b)) for w, a, b in zip(part, plain, toxic, strict=True))

    def _advantages(self, words: list[bytes]) -> list[int]:
        """Of every word, in blocks of as many as are remembered."""
        out: list[int] = []
        for at in range(0, len(words), _REMEMBERED):
            block = words[at : at + _REMEMBERED]
            new = [w for w in block if w not in self.known]
            if new and len(self.known) + len(new) > _REMEMBERED:
                self.known.clear()
                new = block
            self._measure(new)
            out += map(self.known.__getitem__, block)
        return out

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Largest and second largest advantage, log of the sum of those of 3 bytes and more, log of the word count."""
        words = list(set(normalised(text).split()))
        got = [a for a in self._advantages(words) if a > 0]
        top = sorted(got, reverse=True)[:2] + [0, 0]
        return float(top[0]), float(top[1]), math.log1p(sum(a for a in got if a >= 3)), math.log1p(len(words))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _crossed_loss(x: np.ndarray, y: np.ndarray, folds: int = 4) -> float:
    """Mean log loss on calibration documents when each fold is judged by the others; classes are dealt evenly."""
    part = np.zeros(len(y), int)
    for label in (0, 1):
        part[y == label] = np.arange((y == label).sum()) % folds
    x = (x - x.mean(0)) / (x.std(0) + 1e-9)
    loss = 0.0
    for k in range(folds):
        w, b = _logistic(x[part != k], y[part != k])
        p = np.clip(1 / (1 + np.exp(-np.clip(x[part == k] @ w + b, -30, 30))), 1e-6, 1 - 1e-6)
        loss -= float(np.sum(np.where(y[part == k] == 1, np.log(p), np.log(1 - p))))
    return loss / len(y)


def fit(samples: list[tuple[str, int, bool]]) -> Model:
    """samples: (text, toxic, for calibration). Without any toxic or ordinary sample every score is the base rate or 0."""
    train, check = [s for s in samples if not s[2]], [s for s in samples if s[2]]
    sides = [t for t, y, _ in train if y], [t for t, y, _ in train if not y]
    y = np.array([s[1] for s in check], float)
    if not len(y) or y.min() == y.max():
        toxic, ordinary = train_dictionaries(*sides)
        return Model(toxic, ordinary, (0.0,) * 4, (1.0,) * 4, (1.0, 0.0, 0.0, 0.0), -5.0)
    tried = []
    for k, factor in enumerate(FACTORS):
        pair = train_dictionaries(*sides, factor=factor)
        windows = Windows(*pair)
        x = np.array([windows.features(t) for t, _, _ in check])
        tried.append((_crossed_loss(x, y), k, pair, x))
    _, _, (toxic, ordinary), x = min(tried, key=lambda v: v[:2])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w, b = _logistic((x - mean) / scale, y)
    logit = (x - mean) / scale @ w + b
    order = np.argsort(-logit, kind="stable")
    found = np.cumsum(y[order])
    f1 = 2 * found / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.r_[np.diff(logit[order]) < 0, True]
    best = int(np.argmax(np.where(ends, f1, -1)))
    low = logit[order[best + 1]] if best + 1 < len(y) else logit[order[best]] - 1
    cut = (logit[order[best]] + low) / 2
    return Model(toxic, ordinary, tuple(mean), tuple(scale), tuple(w), float(b - cut + math.log(CUT / (1 - CUT))))


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, max_positive: int, max_negative: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of the labelled documents outside the held-out fold that come first by hash: at most max_positive + max_negative rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).groupBy("doc_id").agg(F.max("y").alias("y"))
    first = [known.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, max_positive), (0, max_negative))]
    ids = {r.doc_id: r.y for r in first[0].unionAll(first[1]).collect()}
    spark = docs.sparkSession
    chosen = spark.createDataFrame(list(ids.items()) or [(None, None)], "doc_id long, y int")
    # bounded: max_positive + max_negative ids
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").collect()
    return sorted((r.doc_id, r.text, r.y) for r in rows)


def train(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 2000, max_ordinary: int = 5000) -> Model:
    """A model of the labelled documents outside the held-out fold (crc32 of the id mod 4 is 2), at most so many per class, by hash.

    Of conflicting labels of one id toxic counts; null labels and ids, and labels of unknown documents, are ignored. Without
    labels of both classes every score is the base rate or 0.
    """
    sample = labelled_sample(docs, labels, "toxic", max_toxic, max_ordinary)
    return fit([(text, y, fold(i) == 3) for i, text, y in sample])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, advantage (largest of the text's windows) for every row.

    Null and empty texts are scored as texts without windows; a null doc_id is not held out. Equal texts get
    equal scores. Other columns are ignored and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(model.toxic, model.ordinary)
        mean, scale, w = (np.array(x) for x in (model.mean, model.scale, model.weights))
        for batch in batches:
            x = np.array([windows.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w + model.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(x[:, 0].astype(np.int32))], ["doc_id", "score", "advantage"])

    out = id_text(docs).transform(mapped, run, "doc_id long, score double, advantage int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "advantage")
