"""Decisions of a scorer: extraction, normalisation, verification, rules; and the deterministic scorer."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import lexicons as lx, text as tx

_PERSON = "struct<name: string, title: string, department: string, email: string, research_interests: array<string>, role: string>"
_PEOPLE = f"array<{_PERSON}>"
_POSITION = "struct<exists: string, degree_levels: array<string>, title: string, deadline: string, start_date: string, is_expired: string, evidence_quote: string>"
_FUNDING = "struct<status: string, source: string, evidence_quote: string>"
_FIELD = "struct<score: string, matched_topics: array<string>, rationale: string>"
#: A decision as a scorer gives it. Numbers and flags are read as strings first, since scorers write them in many ways.
RAW = f"struct<page_type: string, people: {_PEOPLE}, position: {_POSITION}, funding: {_FUNDING}, field_match: {_FIELD}, funding_confidence: string, summary: string>"


@dataclass(frozen=True)
class Profile:
    target_fields: list[str]
    keywords: list[str] = field(default_factory=list)
    exclude_topics: list[str] = field(default_factory=list)
    target_degree_levels: list[str] = field(default_factory=lambda: ["phd"])
    min_field_match: float = 0.6
    min_funding_confidence: float = 0.6
    accept_partial: bool = True
    accept_unclear: bool = False
    current_degree: str = ""
    background: str = ""
    department_tags: list[str] = field(default_factory=list)

    def terms(self) -> list[str]:
        """Fields and keywords, stripped, lower-case, each once, in order."""
        return list(dict.fromkeys(t for t in (x.strip().lower() for x in [*self.target_fields, *self.keywords]) if t))


@F.pandas_udf(T.StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """The first JSON object in free text, code fences aside, as JSON; None without one."""
    decoder = json.JSONDecoder()

    def one(t: str | None) -> str | None:
        t = t or ""
        at = t.find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(t, at)
                return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                at = t.find("{", at + 1)
        return None

    return texts.map(one)


def _score(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNull(), 0.0).when(F.isnan(number), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def normalised(raw: Column) -> Column:
    """A decision from JSON text: unknown statuses are unclear, scores clamped, levels mapped to phd, master, postdoc."""
    d = F.from_json(raw, RAW)
    synonyms = F.create_map(*(F.lit(x) for kv in lx.LEVEL_SYNONYMS.items() for x in kv))
    levels = F.transform(F.coalesce(d["position"]["degree_levels"], F.array().cast("array<string>")), lambda v: F.coalesce(F.try_element_at(synonyms, F.lower(F.trim(v))), F.lower(F.trim(v))))
    status = F.lower(F.trim(F.coalesce(d["funding"]["status"], F.lit("unclear"))))
    people = F.filter(F.coalesce(d["people"], F.array().cast(_PEOPLE)), lambda p: p["name"].isNotNull())
    flag = lambda v: F.coalesce(F.lower(v).isin("true", "1", "yes", "on", "y", "t"), F.lit(False))
    return F.struct(
        F.coalesce(d["page_type"], F.lit("other")).alias("page_type"),
        people.alias("people"),
        flag(d["position"]["exists"]).alias("position_exists"),
        F.array_distinct(F.filter(levels, lambda v: v.isin("phd", "master", "postdoc"))).alias("degree_levels"),
        d["position"]["title"].alias("position_title"),
        d["position"]["deadline"].alias("deadline"),
        d["position"]["start_date"].alias("start_date"),
        flag(d["position"]["is_expired"]).alias("is_expired"),
        d["position"]["evidence_quote"].alias("position_quote"),
        F.when(status.isin("full", "partial", "none"), status).otherwise("unclear").alias("funding_status"),
        d["funding"]["source"].alias("funding_source"),
        d["funding"]["evidence_quote"].alias("funding_quote"),
        _score(d["field_match"]["score"]).alias("field_score"),
        F.coalesce(d["field_match"]["matched_topics"], F.array().cast("array<string>")).alias("matched_topics"),
        F.coalesce(d["field_match"]["rationale"], F.lit("")).alias("rationale"),
        _score(d["funding_confidence"]).alias("funding_confidence"),
        F.coalesce(d["summary"], F.lit("")).alias("summary"),
    )


def valid(raw: Column) -> Column:
    """Whether the JSON text can be a decision: an object whose people all have names."""
    d = F.from_json(raw, RAW)
    named = F.forall(F.coalesce(d["people"], F.array().cast(_PEOPLE)), lambda p: p["name"].isNotNull())
    return F.coalesce(F.try_parse_json(raw).isNotNull() & raw.startswith("{") & named, F.lit(False))


def scored(text: Column, emails: Column, fields: list[str], funding: list[str] | None = None, position: list[str] | None = None, negative: list[str] | None = None) -> Column:
    """The deterministic scorer: a raw decision out of sentences and terms, to be read by normalised() like any other's."""
    low = F.lower(text)
    none = tx.first_sentence_with(text, negative or lx.NEGATIVE_FUNDING)
    money = F.when(none.isNull(), tx.first_sentence_with(text, funding or lx.FUNDING))
    post = tx.first_sentence_with(text, position or lx.POSITION)
    matched = F.filter(F.array(*(F.lit(f.lower()) for f in fields)).cast("array<string>"), lambda f: F.contains(low, f))
    name, title = F.regexp_extract(text, lx.TITLED_NAME, 2), F.regexp_extract(text, lx.TITLED_NAME, 1)
    person = F.struct(name.alias("name"), title.alias("title"), F.get(emails, F.lit(0)).alias("email"), matched.alias("research_interests"), F.lit("supervisor").alias("role"))
    has = lambda *terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
    levels = F.filter(F.array(F.when(has("phd", "doctoral"), "phd"), F.when(has("postdoc"), "postdoc"), F.when(has("master"), "master")), lambda v: v.isNotNull())
    status = F.when(none.isNotNull(), "none").when(money.isNotNull() & F.contains(low, F.lit("fully funded")), "full").when(money.isNotNull(), "partial").otherwise("unclear")
    score = F.when(F.size(matched) == 0, 0.1).otherwise(F.least(F.lit(1.0), F.size(matched) * 0.35))
    return F.struct(
        F.when(post.isNotNull(), "position_ad").when(name != "", "person_profile").otherwise("other").alias("page_type"),
        F.filter(F.array(person), lambda p: p["name"] != "").alias("people"),
        F.struct(post.isNotNull().alias("exists"), levels.alias("degree_levels"), F.lit(False).alias("is_expired"), post.alias("evidence_quote")).alias("position"),
        F.struct(status.alias("status"), F.coalesce(none, money).alias("evidence_quote")).alias("funding"),
        F.struct(score.alias("score"), matched.alias("matched_topics"), F.lit("keyword overlap").alias("rationale")).alias("field_match"),
        F.when(money.isNotNull(), 0.9).otherwise(0.2).alias("funding_confidence"),
        F.lit("deterministic decision").alias("summary"),
    )


def verified(decision: Column, text: Column, page: Column, page_emails: Column, compose: bool = False) -> tuple[Column, Column]:
    """(the decision with people and addresses that the page does not show dropped, struct<position, funding, dropped_people, dropped_emails>).

    text: the page's text, page: title and text, both in match form; quotes have to stand in the text.
    """
    shown = lambda p: tx.name_on_page(p["name"], page)
    listed = lambda p: F.coalesce(F.array_contains(page_emails, F.lower(F.trim(p["email"]))), F.lit(False)) | (F.coalesce(p["email"], F.lit("")) == "")
    people = F.filter(decision["people"], shown)
    quote = lambda q: tx.quote_on_page(tx.match_form(q, compose), text)
    found = F.struct(
        quote(decision["position_quote"]).alias("position"),
        quote(decision["funding_quote"]).alias("funding"),
        F.transform(F.filter(decision["people"], lambda p: ~shown(p)), lambda p: p["name"]).alias("dropped_people"),
        F.transform(F.filter(people, lambda p: ~listed(p)), lambda p: p["email"]).alias("dropped_emails"),
    )
    return decision.withField("people", F.transform(people, lambda p: p.withField("email", F.when(listed(p), p["email"])))), found


def rule_reasons(d: Column, quotes: Column, profile: Profile, today: str) -> Column:
    """Reasons to drop a decision, in a fixed order; none means keep."""
    day = F.left(d["deadline"], F.lit(10))
    date = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))
    paid = d["funding_status"].isin("full", "partial")
    topics = F.lower(F.concat_ws(" ", d["matched_topics"], F.flatten(F.transform(d["people"], lambda p: F.coalesce(p["research_interests"], F.array().cast("array<string>"))))))
    excluded = F.lit(False)
    for t in profile.exclude_topics:
        excluded = excluded | F.contains(topics, F.lit(t.lower()))
    targeted = F.arrays_overlap(d["degree_levels"], F.array(*map(F.lit, profile.target_degree_levels)))
    reasons = [
        F.when(~d["position_exists"], "no_open_position"),
        F.when(d["position_exists"] & ~quotes["position"], "position_evidence_not_on_page"),
        F.when(d["position_exists"], F.when(F.size(d["degree_levels"]) == 0, "degree_level_unknown").when(~targeted, "degree_level_not_targeted")),
        F.when(d["is_expired"] | F.coalesce(date < F.lit(today).cast("date"), F.lit(False)), "expired"),
        F.when(d["funding_status"] == "none", "no_funding").when((d["funding_status"] == "partial") & (not profile.accept_partial), "partial_funding_not_accepted").when((d["funding_status"] == "unclear") & (not profile.accept_unclear), "funding_unclear"),
        F.when(paid & ~quotes["funding"], "funding_evidence_not_on_page"),
        F.when(paid & (d["funding_confidence"] < profile.min_funding_confidence), "low_funding_confidence"),
        F.when(d["field_score"] < profile.min_field_match, "off_field"),
        F.when(excluded, "excluded_topic"),
        F.when(F.size(d["people"]) == 0, "no_person_identified"),
    ]
    return F.array_distinct(F.filter(F.array(*reasons), lambda r: r.isNotNull()))


def user_message(profile_json: Column, meta_json: Column, text: Column, today: str, limit: int = 12000) -> Column:
    """The prompt's user part: the day, the profile, what is known of the page, and its text."""
    part = lambda name, body: F.concat(F.lit(f"<<<{name}\n"), body, F.lit(f"\n{name}>>>\n"))
    return F.concat(F.lit(f"TODAY: {today}\n\n"), part("PROFILE", profile_json), F.lit("\n"), part("PAGE_META", meta_json), F.lit("\n"), part("PAGE_TEXT", tx.truncated(text, limit)))


def from_cache(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """pages (cache_key) with reply from the cache and cached: a left join on the key."""
    return pages.join(cache.select("cache_key", "reply").dropDuplicates(["cache_key"]), "cache_key", "left").withColumn("cached", F.col("reply").isNotNull())
