"""The classifier: prompts, cached replies, a budget, a scorer, and what becomes of its answers."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicons as lx, text as tx
from ..sources.shared import stored
from . import crawl, decisions as dc

PROMPT_VERSION = "1"
MOST_EMAILS, MOST_SIGNALS, MOST_DEGREES, LONGEST_ERROR = 25, 8, 5, 300


class Scorer(Protocol):
    """A model behind a name. score() gets one row per question and adds its answer; an answer is text, or an error."""

    name: str
    model: str

    def score(self, questions: DataFrame) -> DataFrame:
        """questions (cache_key, user) with reply string, error string, input_tokens long, output_tokens long."""


@dataclass
class SentenceScorer:
    """The deterministic scorer, in expressions alone. It reads the prompt like any other model; lexicons may be replaced."""

    name: str = "mock"
    model: str = "sentences-1"
    position: list[str] = field(default_factory=lambda: list(lx.POSITION))
    funding: list[str] = field(default_factory=lambda: list(lx.FUNDING))
    negative: list[str] = field(default_factory=lambda: list(lx.NEGATIVE_FUNDING))
    fields: list[str] = field(default_factory=list)

    def score(self, questions: DataFrame) -> DataFrame:
        page = tx.section(F.col("user"), "<<<PAGE_TEXT", "PAGE_TEXT>>>")
        meta = tx.section(F.col("user"), "<<<PAGE_META", "PAGE_META>>>")
        emails = F.coalesce(F.from_json(F.get_json_object(meta, "$.emails_on_page"), "array<string>"), F.array().cast("array<string>"))
        seen = questions.withColumns({"_page": page, "_emails": emails})
        d = dc.scored(F.col("_page"), F.col("_emails"), self.fields, self.funding, self.position, self.negative)
        answer = F.to_json(d)
        none = F.lit(None).cast("string")
        tokens = F.floor(F.length("user") / 4).cast("bigint")
        return seen.withColumns({"reply": answer, "error": none, "input_tokens": tokens, "output_tokens": F.lit(200).cast("bigint")}).drop("_page", "_emails")


def profile_json(profile: dc.Profile) -> Column:
    names = ("current_degree", "background", "target_degree_levels", "target_fields", "keywords", "exclude_topics")
    value = lambda v: F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)).cast("array<string>")
    return F.to_json(F.struct(*(value(getattr(profile, n)).alias(n) for n in names)))


def meta_json() -> Column:
    """What is known of a page: url, university, title, kind, emails, profile_links, signals (long lists cut)."""
    most = {"position": MOST_SIGNALS, "funding": MOST_SIGNALS, "negative": MOST_DEGREES, "fields": MOST_SIGNALS}
    signals = F.struct(*(F.slice(f"signals.{c}", 1, most[c]).alias(c) if c in most else F.col(f"signals.{c}").alias(c) for c in ("position", "funding", "negative", "degrees", "fields")))
    return F.to_json(
        F.struct(
            "url",
            "university",
            "title",
            F.col("kind").alias("page_kind_hint"),
            F.slice("emails", 1, MOST_EMAILS).alias("emails_on_page"),
            "profile_links",
            signals.alias("keyword_signals"),
        )
    )


def asked(pages: DataFrame, profile: dc.Profile, scorer: Scorer, today: str, system: str = "", limit: int = 12000) -> DataFrame:
    """pages with user (the prompt) and cache_key (prompt version, scorer, system prompt and user message)."""
    out = pages.withColumn("user", dc.user_message(profile_json(profile), meta_json(), F.col("text"), today, limit))
    parts = (F.lit(PROMPT_VERSION), F.lit(scorer.name), F.lit(scorer.model), F.lit(system), F.col("user"))
    return out.withColumn("cache_key", tx.cache_key(*parts))


def classified(pages: DataFrame, profile: dc.Profile, scorer: Scorer, *, today: str, cache: DataFrame | None = None, budget: int = 150, system: str = "", limit: int = 12000) -> DataFrame:
    """pages with cache_key, reply, cached, error, input_tokens, output_tokens, d, verification, reasons, keep.

    pages: university, visit, url, kind, title, text, emails, profile_links, signals. Cached replies are free; of the rest
    the first `budget` visits of a university are asked, the others get the reason llm_budget_exhausted. Errors cost a
    call (llm_error); replies that hold no decision give invalid_llm_output. Answers are written before they are used, so
    that a lost executor never asks again.
    """
    questions = asked(pages, profile, scorer, today, system, limit)
    if cache is not None:
        questions = dc.from_cache(questions, cache)
    else:
        questions = questions.withColumns({"reply": F.lit(None).cast("string"), "cached": F.lit(False)})
    questions = stored(crawl.within_budget(questions, "university", "visit", budget), "questions")
    new = scorer.score(questions.where("allowed and not cached").select("cache_key", "user").dropDuplicates(["cache_key"]))
    answers = stored(new.select("cache_key", F.col("reply").alias("answer"), F.left("error", F.lit(LONGEST_ERROR)).alias("error"), "input_tokens", "output_tokens"), "answers")
    out = questions.join(answers, "cache_key", "left")
    out = out.withColumn("reply", F.coalesce("reply", F.when(F.col("allowed"), F.col("answer")))).drop("answer", "user")
    out = out.withColumn("_json", dc.first_json_object(F.col("reply")))
    out = out.withColumn("_valid", dc.valid(F.col("_json")))
    failure = F.when(~F.col("allowed"), "llm_budget_exhausted").when(~F.col("cached") & F.col("error").isNotNull(), "llm_error").when(~F.col("_valid"), "invalid_llm_output")
    head = F.concat_ws("\n", "title", "text")
    out = out.withColumns({"_failure": failure, "_text": tx.match_form(F.col("text"), True), "_form": tx.match_form(head, True)})
    out = out.withColumn("d", F.when(F.col("_failure").isNull(), dc.normalised(F.col("_json"))))
    # the reply's reading is written once: later expressions stay small
    out = stored(out.drop("_json", "_valid"), "readings")
    checked, verification = dc.verified(out["d"], out["_text"], out["_form"], out["emails"], True)
    out = stored(out.withColumns({"verification": verification, "d": F.when(F.col("_failure").isNull(), checked)}), "verified")
    rules = dc.rule_reasons(F.col("d"), F.col("verification"), profile, today)
    out = out.withColumn("reasons", F.when(F.col("_failure").isNotNull(), F.array("_failure")).otherwise(rules))
    return out.withColumn("keep", F.size("reasons") == 0).drop("_failure", "_text", "_form")


def new_replies(outcomes: DataFrame) -> DataFrame:
    """cache_key, reply: what goes into the cache: replies that were asked for and could be read."""
    return outcomes.where("not cached and d is not null").select("cache_key", "reply")


def hallucinations(outcomes: DataFrame) -> DataFrame:
    """url, dropped_people, dropped_emails of the pages on which verification blocked something."""
    v = outcomes.select("url", "verification.dropped_people", "verification.dropped_emails")
    return v.where("size(dropped_people) > 0 or size(dropped_emails) > 0")


def call_statistics(outcomes: DataFrame) -> DataFrame:
    """university, calls, cache_hits, errors, invalid, skipped, input_tokens, output_tokens."""
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))
    asked_ = F.col("allowed") & ~F.col("cached")
    return outcomes.groupBy("university").agg(
        n(asked_).alias("calls"),
        n(F.col("cached")).alias("cache_hits"),
        n(F.array_contains("reasons", "llm_error")).alias("errors"),
        n(F.array_contains("reasons", "invalid_llm_output")).alias("invalid"),
        n(~F.col("allowed")).alias("skipped"),
        F.coalesce(F.sum(F.when(asked_, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(asked_, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
    )
