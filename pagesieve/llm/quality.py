"""Quality classifier by co-training.

Two views of a document: its text (13 measures of content and repetition) and its page metadata (language,
source, length). A logistic classifier per view is fitted on labelled documents; over several rounds each
scores all documents and hands its most confident ones to the other as pseudo-labels. At the end both views
are calibrated together on labelled documents kept out of training, and that score decides.

Training takes the labelled documents of smallest hash, at most ``max_labelled`` per class. Candidates for
pseudo-labels are all documents without a label, equal feature vectors once. Per round, view and class the share
``confident`` of those the view has not handed over yet goes to the other, the most confident first, if ``sure``.
They stay where they are: each Newton step of a fit sums over them in one pass. Scores cover every document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import mapped, stored
from .toxicity import _logistic, fold, labelled_sample

N_TEXT, N_META = 13, 27
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])
_DIGIT = np.array([48 <= i <= 57 for i in range(256)])
_SYMBOL = np.array([chr(i) in "#$%&*@^~<>{}[]\\=+_" for i in range(256)])
_MARKS = np.array([chr(i) in "!?" for i in range(256)])


def text_features(text: str) -> list[float]:
    """Measures of a text; all 0 without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_TEXT
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size, letters = int(raw.sum()), max(int(raw[_LETTER].sum()), 1)
    counts = Counter(words)
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(n),
        len(counts) / n,
        max(counts.values()) / n,
        repeats,
        min(sum(map(len, words)) / n, 50.0) / 10,
        raw[_UPPER].sum() / letters,
        raw[_DIGIT].sum() / size * 10,
        raw[_SYMBOL].sum() / size * 10,
        raw[_MARKS].sum() / size * 10,
        raw[124] / size * 10,
        raw[46] / n,
        len(set(lines)) / max(len(lines), 1),
        letters / size,
    ]


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Hashed language (8) and source (16) indicators; known length, its logarithm and the square of that."""
    out = [0.0] * N_META
    out[xxhash.xxh32_intdigest(lang or "") % 8] = 1.0
    out[8 + xxhash.xxh32_intdigest(source or "") % 16] = 1.0
    size = math.log1p(max(n_chars or 0, 0)) / 5
    out[24:] = [float(n_chars is not None), size, size * size]
    return out


def _views(batch: pa.RecordBatch, at: tuple[int, int, int, int]) -> np.ndarray:
    text, lang, source, size = (batch.column(i).to_pylist() for i in at)
    rows = [text_features(t or "") + meta_features(g, s, n) for t, g, s, n in zip(text, lang, source, size, strict=True)]
    return np.array(rows, np.float64).reshape(-1, N_TEXT + N_META)


def _columns(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source, n_chars) with absent metadata as nulls."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*(docs[c].cast(k).alias(c) if c in docs.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


@dataclass(frozen=True)
class Model:
    """mean and scale of all features; weights and bias by view; weights of both logits and bias; least score to keep."""

    mean: np.ndarray
    scale: np.ndarray
    views: tuple[tuple[np.ndarray, float], tuple[np.ndarray, float]]
    mix: tuple[float, float, float]
    least: float

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - self.mean) / self.scale
        (wt, bt), (wm, bm) = self.views
        return np.clip(z[:, :N_TEXT] @ wt + bt, -20, 20), np.clip(z[:, N_TEXT:] @ wm + bm, -20, 20)

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the text view, the metadata view and both together."""
        t, m = self.logits(x)
        return tuple(1 / (1 + np.exp(-v)) for v in (t, m, self.mix[0] * t + self.mix[1] * m + self.mix[2]))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, x array<float> for every row, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _views(batch, (1, 2, 3, 4)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    return stored(_columns(docs).transform(mapped, run, "doc_id long, x array<float>"), "quality-features")


_CUT = {"t": slice(0, N_TEXT), "m": slice(N_TEXT, N_TEXT + N_META)}
_OTHER = {"t": "m", "m": "t"}


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, N_TEXT + N_META)


def _given(z: np.ndarray, view: str, rounds: list[tuple[np.ndarray, float, float, float]]) -> np.ndarray:
    """Labels that a view has handed over in the rounds so far (weights, bias, highest bad and least good logit); nan for rows not yet."""
    out = np.full(len(z), np.nan)
    for w, b, low, high in rounds:
        logit = z[:, _CUT[view]] @ w + b
        free = np.isnan(out)
        out[free & (logit >= high)] = 1.0
        out[free & (logit <= low)] = 0.0
    return out


def candidates(table: DataFrame, labels: DataFrame) -> DataFrame:
    """x of the documents without a label, equal ones once, in the shared folder."""
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").select("doc_id")
    return stored(table.join(labelled, "doc_id", "left_anti").select("x").distinct(), "quality-candidates")


def _cuts(free: DataFrame, mean: np.ndarray, scale: np.ndarray, fitted: dict, handed: dict, confident: float, sure: float) -> dict[str, tuple[float, float]]:
    """For each view the highest bad and the least good logit that it hands over in this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (_rows(batch) - mean) / scale
            logits = []
            for v in "tm":
                logit = z[:, _CUT[v]] @ fitted[v][0] + fitted[v][1]
                logits.append(pa.array(logit, mask=~np.isnan(_given(z, v, handed[v]))))
            yield pa.RecordBatch.from_arrays(logits, ["t", "m"])

    least = math.log(sure / (1 - sure))
    found = free.transform(mapped, run, "t double, m double").agg(*(F.percentile_approx(v, [confident, 1 - confident], 100_000).alias(v) for v in "tm")).first()
    return {v: (min(found[v][0], -least), max(found[v][1], least)) if found[v] else (-math.inf, math.inf) for v in "tm"}


def _refitted(free: DataFrame, mean: np.ndarray, scale: np.ndarray, z: np.ndarray, y: np.ndarray, fitted: dict, handed: dict, ridge: float) -> dict:
    """Both views fitted on the labelled rows z, y and on what the other view has handed over."""
    start = {v: np.r_[fitted[v][0], fitted[v][1]] for v in "tm"}
    sizes = {v: len(start[v]) for v in "tm"}

    def sums(z: np.ndarray, y: np.ndarray, v: str, w: np.ndarray) -> np.ndarray:
        a = np.c_[z[:, _CUT[v]], np.ones(len(z))]
        logit = a @ w
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return np.r_[(a.T @ (a * (p * (1 - p))[:, None])).ravel(), a.T @ (y - p), float(np.sum(np.logaddexp(0, logit) - y * logit))]

    length = sum(n * n + n + 1 for n in sizes.values())
    done = {v: (math.inf, start[v], np.zeros(sizes[v])) for v in "tm"}
    for _ in range(60):

        def run(batches: Iterator[pa.RecordBatch], at=dict(start)) -> Iterator[pa.RecordBatch]:
            total = np.zeros(length)
            for batch in batches:
                q = (_rows(batch) - mean) / scale
                parts = []
                for v in "tm":
                    label = _given(q, _OTHER[v], handed[_OTHER[v]])
                    has = ~np.isnan(label)
                    parts.append(sums(q[has], label[has], v, at[v]))
                total += np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

        # one row of some thousand sums per partition
        total = np.zeros(length)
        for r in free.transform(mapped, run, "s array<double>").collect():
            total += np.array(r.s)
        largest, first = 0.0, 0
        for v in "tm":
            n = sizes[v]
            s = total[first : first + n * n + n + 1] + sums(z, y, v, start[v])
            first += n * n + n + 1
            penalty = np.diag([ridge] * (n - 1) + [1e-6])
            loss, (least, good, step) = s[-1] + start[v] @ penalty @ start[v] / 2, done[v]
            if loss > least + 1e-9 * abs(least):
                # too far: back to the last good weights, half the step
                step = step / 2
            else:
                least, good = loss, start[v]
                step = np.linalg.solve(s[: n * n].reshape(n, n) + penalty, s[n * n : -1] - penalty @ start[v])
            done[v], start[v] = (least, good, step), good + step
            largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-5:
            break
    return {v: (start[v][:-1], float(start[v][-1])) for v in "tm"}


def train(docs: DataFrame, labels: DataFrame, table: DataFrame, *, rounds: int = 3, max_labelled: int = 3000, confident: float = 0.05, sure: float = 0.95, lost: float = 0.002) -> Model:
    """confident: the share of the candidates that a view hands over per round and class. lost: the share of good calibration documents that may score too low to be kept."""
    sample = labelled_sample(docs, labels, "quality", max_labelled, max_labelled)
    known = sorted({i: (t, y) for i, t, y in sample}.items())
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i, _ in known] or [(None,)], "doc_id long")
    # bounded: twice max_labelled ids
    vectors = {r.doc_id: r.x for r in table.join(F.broadcast(wanted), "doc_id").collect()}
    x = np.array([vectors[i] for i, _ in known if i in vectors], np.float64).reshape(-1, N_TEXT + N_META)
    y = np.array([y for i, (_, y) in known if i in vectors], np.float64)
    held = np.array([fold(i) == 3 for i, _ in known if i in vectors], bool)
    if not len(y) or y.min() == y.max() or not held.any() or held.all() or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        return Model(np.zeros(N_TEXT + N_META), np.ones(N_TEXT + N_META), ((np.zeros(N_TEXT), 0.0), (np.zeros(N_META), 0.0)), (1.0, 1.0, 0.0), 0.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    # a feature outside what labelled documents show says no more than their extremes do
    z = (x - mean) / scale
    fitted = {v: _logistic(z[~held][:, _CUT[v]], y[~held], ridge=2.0) for v in "tm"}
    free = candidates(table, labels)
    handed: dict[str, list] = {"t": [], "m": []}
    for _ in range(rounds):
        cuts = _cuts(free, mean, scale, fitted, handed, confident, sure)
        for v in "tm":
            handed[v].append((*fitted[v], *cuts[v]))
        fitted = _refitted(free, mean, scale, z[~held], y[~held], fitted, handed, 2.0)
    model = Model(mean, scale, (fitted["t"], fitted["m"]), (1.0, 1.0, 0.0), 0.0)
    t, m = model.logits(x[held])
    w, b = _logistic(np.c_[t, m], y[held], ridge=0.1)
    model = Model(mean, scale, model.views, (float(w[0]), float(w[1]), b), 0.0)
    good = np.sort(model.scores(x[held])[2][y[held] == 1])
    return Model(mean, scale, model.views, model.mix, float(min(0.5, good[int(lost * len(good))])))


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, text_score, meta_score, score (likelihood of label 1), kept for every row.

    Null texts are empty, absent metadata counts as null, labels of unknown documents are ignored, conflicting ones count
    as good. Without labels of both classes all score 0.5 and are kept. Equal rows get equal scores; an empty table gives an empty result.
    """
    table = feature_table(docs)
    model = train(docs, labels, table, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, N_TEXT + N_META)
            t, m, s = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t), pa.array(m), pa.array(s), pa.array(s >= model.least)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return table.transform(mapped, run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, all columns as given: scored in the pass that filters them, without a join.

    Handling of nulls, empty texts, repeats and labels is that of score(); columns of any other name pass through.
    """
    model = train(docs, labels, feature_table(docs), **options)
    names = docs.columns
    at = tuple(names.index(c) if c in names else -1 for c in ("text", "lang", "source", "n_chars"))
    plain = docs.select(*(F.col(f"`{c}`").cast(k).alias(c) if (k := {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}.get(c)) else F.col(f"`{c}`") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang, source, size = (batch.column(i).to_pylist() if i >= 0 else [None] * batch.num_rows for i in at)
            rows = [text_features(t or "") + meta_features(g, s, n) for t, g, s, n in zip(text, lang, source, size, strict=True)]
            # as in the table of features: single precision
            x = np.array(rows, np.float32).astype(np.float64).reshape(-1, N_TEXT + N_META)
            yield batch.filter(pa.array(model.scores(x)[2] >= model.least))

    return plain.transform(mapped, run, plain.schema)
