"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table predicts, for every document, how likely it belongs to each domain:
multinomial Bayes over letter frequencies, as if a text had ``evidence`` letters, so memberships stay soft.
Projected gradient descent then fits a rate >= 0 per document, starting from 1, that minimises the squared
difference between expected tokens by domain, sum(rate * tokens * posterior), and their targets, each domain's
divided by what it holds. Since posteriors add up to 1 per document, no direction is steeper than 1: that is the step.

Everything is a DataFrame expression. A document's rate depends on its own posterior and on the sequence of
domain residuals alone, so each step aggregates one number per domain over all documents and the rate is a
fold of the residuals so far: no table of rates is written or joined, and only a number per domain and step
reaches the driver. With more than UNROLLED domains the same sums are taken by position instead of by column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, stored

UNROLLED = 64
# Fixed value: letters counted one by one; all other characters count together.
LETTERS = "äöüßéèêçñóíwkhzujqpgbfmclrt"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it and whatever projections Catalyst merges."""
    return F.element_at(F.transform(F.array(value), body), 1)


def letter_counts(low: Column) -> list[Column]:
    """Counts in a lower-cased text."""
    size = F.length(low)
    counts = [(size - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("int") for c in LETTERS]
    return [*counts, size.cast("int")]


def _features(docs: DataFrame, domain: str) -> DataFrame:
    """doc_id, domain, tokens, counts (array<int>: the letters, then all characters)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    name = docs[domain].cast("string") if domain in docs.columns else F.lit(None).cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), name.alias("domain"), token_count(text).alias("tokens"), F.array(*letter_counts(F.lower(text))).alias("counts"))


def token_count(text: Column) -> Column:
    """Words outside ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


@dataclass
class Model:
    """domains, their log priors and log letter shares; targets; residuals already divided by the step's scale."""

    domains: list[str]
    prior: list[float]
    shares: list[list[float]]
    evidence: float
    steps: list[list[float]] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)
    missed: float = 0.0

    def posterior(self, counts: Column) -> Column:
        """An array with one share per domain; they add up to 1. A text without characters gets the priors."""
        n = len(LETTERS)

        def rest(c: Column) -> Column:
            """Counts of the letters, then of all other characters."""
            letters = F.slice(c, 1, n)
            return F.concat(letters, F.array(F.element_at(c, n + 1) - F.aggregate(letters, F.lit(0), lambda a, x: a + x)))

        def logs(c: Column) -> Column:
            size = F.element_at(c, n + 1)
            if len(self.domains) > UNROLLED:
                table = F.array(*(F.struct(F.lit(prior).alias("p"), F.array(*map(F.lit, share)).alias("w")) for prior, share in zip(self.prior, self.shares, strict=True)))
                score = lambda part, d: F.aggregate(F.zip_with(part, d["w"], lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
                each_ = lambda part: F.transform(table, lambda d: d["p"] + F.when(size > 0, score(part, d) / size * F.lit(self.evidence)).otherwise(0.0))
                return let(rest(c), each_)
            part = [F.element_at(c, i + 1) for i in range(n)]
            part.append(size - sum(part[1:], part[0]))
            each = []
            for prior, share in zip(self.prior, self.shares, strict=True):
                total = sum((x * F.lit(w) for x, w in zip(part, share, strict=True)), F.lit(0.0))
                each.append(F.lit(prior) + F.when(size > 0, total / size * F.lit(self.evidence)).otherwise(0.0))
            return F.array(*each)

        def shares(log: Column) -> Column:
            return let(F.array_max(log), lambda top: F.transform(log, lambda v: F.exp(v - top)))

        def whole(weights: Column) -> Column:
            return let(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), lambda total: F.transform(weights, lambda w: w / total))

        return let(counts, lambda c: let(logs(c), lambda log: let(shares(log), whole)))

    def rate(self, posterior: Column) -> Column:
        if not self.steps:
            return F.lit(1.0)
        history = F.array(*(F.array(*(F.lit(float(e)) for e in step)) for step in self.steps))

        def fold(p: Column) -> Column:
            if len(self.domains) > UNROLLED:
                down = lambda e: F.aggregate(F.zip_with(p, e, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
            else:
                down = lambda e: sum((F.element_at(p, k + 1) * F.element_at(e, k + 1) for k in range(len(self.domains))), F.lit(0.0))
            return F.aggregate(history, F.lit(1.0), lambda r, e: F.greatest(F.lit(0.0), r - down(e)))

        return let(posterior, fold)


def _fit_classifier(features: DataFrame, labels: DataFrame, evidence: float) -> Model:
    n = len(LETTERS)
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    labelled = features.where("domain is not null").join(known, "doc_id", "left_semi")
    sums = [F.sum(F.element_at("counts", i + 1).cast("long")).alias(f"c{i}") for i in range(n + 1)]
    rows = labelled.groupBy("domain").agg(F.count("*").alias("docs"), *sums).orderBy("domain").collect()
    rows = rows or [{"domain": "", "docs": 1, **{f"c{i}": 0 for i in range(n + 1)}}]
    total = sum(r["docs"] for r in rows)
    shares = []
    for r in rows:
        counts = [r[f"c{i}"] for i in range(n)]
        counts.append(max(r[f"c{n}"] - sum(counts), 0))
        whole = sum(counts) + 0.5 * len(counts)
        shares.append([math.log((c + 0.5) / whole) for c in counts])
    return Model([r["domain"] for r in rows], [math.log(r["docs"] / total) for r in rows], shares, evidence)


def _totals(table: DataFrame, rate: Column, domains: int) -> np.ndarray:
    """Expected tokens by domain at that rate."""
    if domains > UNROLLED:
        each = table.select((F.col("tokens") * rate).alias("t"), F.posexplode("posterior").alias("k", "p"))
        out = np.zeros(domains)
        for r in each.groupBy("k").agg(F.sum(F.col("t") * F.col("p")).alias("s")).collect():
            out[r.k] = r.s or 0.0
        return out
    p = [F.element_at("posterior", i + 1) for i in range(domains)]
    row = table.agg(*(F.sum(F.col("tokens") * x * rate).alias(f"s{i}") for i, x in enumerate(p))).first()
    return np.array([v or 0.0 for v in row], float)


def fit(docs: DataFrame, labels: DataFrame, *, domain: str = "lang", weights: dict[str, float] | None = None, temper: float = 0.5, evidence: float = 60.0, steps: int = 200, tolerance: float = 1e-3) -> tuple[Model, DataFrame]:
    """The fitted model, and the stored table doc_id, tokens, posterior (array<double>) of every document.

    weights: target share of tokens by domain (of all tokens; normalised, absent domains 0); by default the
    present expected shares to the power of temper, normalised. Steps end where every domain is within the tolerance of its
    target, where they no longer change anything (targets that no rates reach), or after so many; model.missed
    says how far off the worst domain still is.
    """
    features = stored(_features(docs, domain), "mix-features")
    model = _fit_classifier(features, labels, evidence)
    table = stored(features.select("doc_id", "tokens", model.posterior(F.col("counts")).alias("posterior")), "mix-posteriors")
    n = len(model.domains)
    now = _totals(table, F.lit(1.0), n)
    whole = float(now.sum())
    if weights is None:
        aim = np.where(now > 0, np.maximum(now, 1e-300) ** temper, 0)
    else:
        aim = np.array([weights.get(d, 0.0) for d in model.domains], float)
    aim = aim / aim.sum() * whole if aim.sum() > 0 else now
    model.targets, model.reached = aim.tolist(), now.tolist()
    if whole <= 0:
        return model, table
    # of all matrices sum(tokens * p * p') / scale with these row sums none has an eigenvalue above 1
    scale = np.maximum(now, 1e-12 * whole)
    within = tolerance * np.maximum(aim, 0.01 * whole)
    for _ in range(steps):
        off = now - aim
        if np.all(np.abs(off) <= within):
            break
        model.steps.append((off / scale).tolist())
        after = _totals(table, model.rate(F.col("posterior")), n)
        model.reached, stuck = after.tolist(), np.abs(after - now).max() <= 1e-6 * whole
        now = after
        if stuck:
            break
    model.missed = float(np.max(np.abs(now - aim) / np.maximum(aim, 0.01 * whole)))
    return model, table


def copies(doc_id: Column, rate: Column) -> Column:
    """The rate as a whole number of copies: its floor, plus one with the probability of the rest, by hash of the id."""
    draw = (F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1 << 30)) + F.lit(0.5)) / float(1 << 30)
    return F.floor(rate + draw).cast("int")


def rates(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, tokens, domain (likeliest), posteriors ('name=share' joined by blanks), rate, copies, missed for every row.

    missed: the largest distance of a domain's expected tokens from their target after the fit, as a share of the target
    (of 1% of all tokens at least); the same in all rows.

    Null and empty texts have 0 tokens and the prior memberships; they change no total and follow their rate all the same. Null
    ids share one draw. Without labelled documents there is one domain '' and all rates are 1. Repeated rows get equal rates;
    an empty table gives an empty result; other columns are ignored.
    """
    model, table = fit(docs, labels, **options)
    names = F.array(*(F.lit(d) for d in model.domains))
    best = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    shown = F.array_join(F.zip_with(names, "posterior", lambda d, x: F.concat(d, F.lit("="), F.format_number(x, 4))), " ")
    rated = table.withColumn("rate", model.rate(F.col("posterior")))
    return rated.select("doc_id", "tokens", best.alias("domain"), shown.alias("posteriors"), "rate", copies(F.col("doc_id"), F.col("rate")).alias("copies"), F.lit(model.missed).alias("missed"))


def mixed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with every row as often as its copies say (rates as in rates()), columns as given. The rate is computed in place: no join."""
    model, _ = fit(docs, labels, **options)
    low = F.lower(F.coalesce(docs["text"].cast("string"), F.lit("")))
    rate = model.rate(model.posterior(let(low, lambda t: F.array(*letter_counts(t)))))
    times = F.explode(F.array_repeat(F.lit(1), copies(docs["doc_id"].cast("long"), rate)))
    return docs.select("*", times.alias(free_name(docs, "copy"))).select(docs.columns)
