"""Registry of queries, and what their SQL shares. The SQL says the same as a query, written independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ...functions import lexicons as lx
from ...operators import decisions as dc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Lexicons of words that the synthetic texts hold: the real ones never occur there.
POSITION, FUNDING, NEGATIVE, FIELDS = ["and this", "thble", "for"], ["with", "ndonre"], ["the and"], ["that", "erthth", "ingou"]
TERMS = {"position": POSITION, "funding": FUNDING, "negative": NEGATIVE}
PROFILE = dc.Profile(FIELDS, ["Thand "], min_field_match=0.3, accept_unclear=True)
DOMAINS = ["example.com", "th.example.org"]


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def literal(v) -> str:
    """A value as DuckDB writes it."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"'{k}': {literal(x)}" for k, x in v.items()) + "}"
    return "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """The same inline relation for DuckDB."""
    return "(values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") as t({columns})"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- SQL of URLs -------------------------------------------------------------------------------------------------

HOST = "regexp_extract(lower(url), '^https?://([^/?#:]*)', 1)"
_RAW_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
PATH = f"case when {_RAW_PATH} = '' then '/' else {_RAW_PATH} end"
QUERY = "regexp_extract(url, '[?]([^#]*)', 1)"
_KEPT = f"list_filter(string_split({QUERY}, '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid|ref_src)='))"
ORIGIN = f"regexp_extract(lower(url), '^https?', 0) || '://' || {HOST}"
CANON = f"{ORIGIN} || ({PATH}) || case when {_KEPT} = [] then '' else '?' || array_to_string({_KEPT}, '&') end"
TOKENS = "list_distinct(list_filter(string_split_regex(lower(url), '[^a-z0-9~äöüß]+'), lambda x: x <> ''))"


def any_of(terms: list[str], text: str) -> str:
    """Whether a text contains any of the terms."""
    return f"len(list_filter({literal(terms)}, lambda t: contains({text}, t))) > 0"


def link_score(fields: list[str], anchor: str = "anchor") -> str:
    said, all_ = f"lower(coalesce({anchor}, ''))", f"lower(url || ' ' || coalesce({anchor}, ''))"
    hit = lambda terms: f"list_has_any({TOKENS}, {literal(terms)})"
    parts = [
        f"case when {hit(lx.JOBS_PATH)} or {any_of(lx.POSITION, said)} then 6 else 0 end",
        f"case when {hit(lx.PEOPLE_PATH)} or contains(url, '/~') then 4 else 0 end",
        f"case when {hit(lx.RESEARCH_PATH)} then 3 else 0 end",
        f"case when {any_of(fields, all_)} then 3 else 0 end",
    ]
    return f"({' + '.join(parts)} - case when {hit(lx.LOW_VALUE_PATH)} then 5 else 0 end)::int"


# --- SQL of texts ------------------------------------------------------------------------------------------------

DISTINCT = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def ordered_distinct(x: str) -> str:
    return DISTINCT.replace("{x}", x)


EMAIL = "[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+[.][A-Za-z]{2,24}"


def emails(text: str) -> str:
    return ordered_distinct(f"list_transform(regexp_extract_all({text}, '{EMAIL}'), lambda x: lower(x))")


def hits(text: str, terms: list[str]) -> str:
    """Terms found, leftmost and not overlapping: every sign that is not part of a word stands twice, so that neighbours need not share one."""
    twice = lambda s: s.replace(" ", "  ")
    longest = sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t))
    rx = "[^\\p{L}\\p{N}_](" + "|".join(map(twice, longest)) + ")[^\\p{L}\\p{N}_]"
    doubled = f"'  ' || regexp_replace(lower({text}), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') || '  '"
    return ordered_distinct(f"list_transform(regexp_extract_all({doubled}, '{rx}', 1), lambda x: replace(x, '  ', ' '))")


def sentence_with(text: str, terms: list[str]) -> str:
    """First sentence of more than 15 characters with one of the terms, or NULL."""
    cut = f"string_split(replace(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(10), chr(1)), chr(1))"
    low = "lower(s)"
    return f"left(trim(list_filter({cut}, lambda s: length(s) > 15 and {any_of(terms, low)})[1]), 300)"


def match_form(text: str) -> str:
    plain = f"translate(lower({text}), '‘’“”‐‑‒–—―', '''''\"\"------')"
    return f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"


PREFILTER = """case when length(text) < 200 then 'too_little_text' when kind = 'listing' then 'listing_page_follow_links_instead'
 when negative and not funding then 'page_states_no_funding' when kind = 'position' and (position or funding) then 'position_page'
 when kind = 'profile' and field then 'profile_with_field_terms' when position and (funding or field) then 'position_terms_with_funding_or_field'
 when kind = 'profile' and position then 'profile_mentions_openings' else 'no_position_or_field_signal' end"""
