"""Decisions and records."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from ...functions import lexicons as lx
from ...operators import classify as cl, decisions as dc, entities as en, replies as rp
from ...sources import sinks
from ...sources.snapshots import table
from .. import pipeline as pl
from .base import FIELDS, FUNDING, NEGATIVE, POSITION, PREFILTER, PROFILE, TERMS, frame, literal, match_form, query, sentence_with, values
from .pages import ANALYSED, CANON

_LOW = "lower(text)"
_MATCHED = f"list_filter({literal(FIELDS)}, lambda f: contains({_LOW}, f))"
_TITLED = "(Prof[.]?(?: Dr[.])?|Dr[.]) +([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})"


def scored_sql(table_: str, keep: str = "doc_id") -> str:
    """The deterministic scorer's decision about every text."""
    return f"""select *, case when post is not null then 'position_ad' when person <> '' then 'person_profile' else 'other' end as page_type,
  case when none is not null then 'none' when money is not null and contains({_LOW}, 'fully funded') then 'full' when money is not null then 'partial' else 'unclear' end as status,
  coalesce(none, money) as funding_quote, case when len(matched) = 0 then 0.1 else least(1.0, 0.35 * len(matched)) end::double as score, case when money is not null then 0.9 else 0.2 end::double as confidence
 from (select *, case when none is null then money_ end as money from (select {keep}, text, {sentence_with('text', NEGATIVE)} as none, {sentence_with('text', FUNDING)} as money_, {sentence_with('text', POSITION)} as post, {_MATCHED} as matched,
  regexp_extract(text, '{_TITLED}', 2) as person, regexp_extract(text, '{_TITLED}', 1) as title,
  list_filter([case when contains({_LOW}, 'phd') or contains({_LOW}, 'doctoral') then 'phd' end, case when contains({_LOW}, 'postdoc') then 'postdoc' end, case when contains({_LOW}, 'master') then 'master' end], lambda x: x is not null) as levels
  from {table_}))"""


_INTRODUCED = "(select doc_id, case when doc_id % 3 = 0 then 'Prof. Dr. Ada Byron writes to a doctoral student. ' else '' end || text as text from documents)"


@query(f"""select doc_id, page_type, person, title, post, status, funding_quote, round(score, 6) as score, confidence, array_to_string(matched, ' ') as matched, array_to_string(levels, ' ') as levels from ({scored_sql(_INTRODUCED)})""")
def mock_scorer(spark, d):
    """Every field of the deterministic scorer's decision."""
    said = F.concat(F.when(F.col("doc_id") % 3 == 0, "Prof. Dr. Ada Byron writes to a doctoral student. ").otherwise(""), "text")
    raw = dc.scored(said, F.array().cast("array<string>"), FIELDS, FUNDING, POSITION, NEGATIVE)
    s = table(spark, d, "documents").select("doc_id", raw.alias("d"))
    person = F.get("d.people", F.lit(0))
    return s.select(
        "doc_id",
        "d.page_type",
        F.coalesce(person["name"], F.lit("")).alias("person"),
        F.coalesce(person["title"], F.lit("")).alias("title"),
        F.col("d.position.evidence_quote").alias("post"),
        F.col("d.funding.status").alias("status"),
        F.col("d.funding.evidence_quote").alias("funding_quote"),
        F.round("d.field_match.score", 6).alias("score"),
        F.col("d.funding_confidence").alias("confidence"),
        F.array_join("d.field_match.matched_topics", " ").alias("matched"),
        F.array_join("d.position.degree_levels", " ").alias("levels"),
    )


# --- JSON in free text -------------------------------------------------------------------------------------------

_REPLIES = [('```json\n{"a": 1}\n```',), ('see {x} then {"b": {"c": "}"}} end',), ("none",), ('{"open": "never closed', ), ('[1, 2] {} {"z": 1}',), ('a "{" b {"q": "\\"{", "r": [{"s": null}]}',)]
_TALK = "'Reply {' || conv_id || '} is {\"turn\": ' || turn || ', \"at\": {\"role\": \"' || role || '\"}} and {\"no\": 1}'"
_SPANS = "flatten(list_transform(list_filter(range(1, length(reply) + 1), lambda i: substr(reply, i, 1) = '{'), lambda i: list_transform(list_filter(range(i, length(reply) + 1), lambda j: substr(reply, j, 1) = '}' and json_valid(substr(reply, i, j - i + 1))), lambda j: substr(reply, i, j - i + 1))))"


@query(f"select reply, json(({_SPANS})[1])::varchar as object from (select reply from {values(_REPLIES, 'reply')} union all select {_TALK} from conversations)")
def json_extract(spark, d):
    """The first JSON object in each reply."""
    parts = [F.lit("Reply {"), "conv_id", F.lit('} is {"turn": '), "turn", F.lit(', "at": {"role": "'), "role", F.lit('"}} and {"no": 1}')]
    both = frame(spark, _REPLIES, "reply string").unionAll(table(spark, d, "conversations").select(F.concat(*parts)))
    return both.select("reply", dc.first_json_object(F.col("reply")).alias("object"))


_RAW = [
    ('{"funding": {"status": "FULL"}, "field_match": {"score": "0.7"}, "funding_confidence": 3, "position": {"exists": true, "degree_levels": ["PhD", "doctoral", "msc", "ba"]}}',),
    ('{"funding": {"status": "maybe"}, "field_match": {"score": "x"}}',),
    ("{}",),
]
_MADE = """'{"page_type": "' || event_type || '", "position": {"exists": ' || case when event_id % 2 = 0 then 'true' else '"no"' end || ', "degree_levels": ["' || ['PhD', 'Msc', 'post-doc', 'x'][event_id % 4 + 1] || '", "' || ['ph.d.', 'masters', 'postdoc', ' PHD '][event_id % 4 + 1] || '"], "is_expired": ' || case when event_id % 5 = 0 then 'true' else 'null' end
 || '}, "funding": {"status": ' || ['"full"', '" Partial "', '"none"', 'null', '"free"'][event_id % 5 + 1] || '}, "field_match": {"score": ' || (value / 100) || '}, "funding_confidence": "' || (value / 200 - 0.1) || '"}'"""
_CLAMP = "case when {x} is null then 0.0 else least(1.0, greatest(0.0, {x})) end::double"
_NUMBER = lambda path: _CLAMP.replace("{x}", f"try_cast(json_extract_string(raw, '{path}') as double)")
_SYNONYM = "case lower(trim(v)) " + " ".join(f"when {literal(a)} then {literal(b)}" for a, b in lx.LEVEL_SYNONYMS.items()) + " else lower(trim(v)) end"
_MAPPED = f"list_filter(list_transform(coalesce(json_extract_string(raw, '$.position.degree_levels[*]'), []), lambda v: {_SYNONYM}), lambda v: v in ('phd', 'master', 'postdoc'))"
_FLAG = lambda path: f"coalesce(lower(json_extract_string(raw, '{path}')) in ('true', '1', 'yes', 'on', 'y', 't'), false)"
_STATUS = "lower(trim(coalesce(json_extract_string(raw, '$.funding.status'), 'unclear')))"


def _made_decisions(spark, d) -> DataFrame:
    k = F.col("event_id")
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    number = lambda c: F.col(c) if isinstance(c, str) else c
    parts = [
        F.lit('{"page_type": "'), F.col("event_type"), F.lit('", "position": {"exists": '), F.when(k % 2 == 0, "true").otherwise('"no"'), F.lit(', "degree_levels": ["'), pick(["PhD", "Msc", "post-doc", "x"], 4), F.lit('", "'),
        pick(["ph.d.", "masters", "postdoc", " PHD "], 4), F.lit('"], "is_expired": '), F.when(k % 5 == 0, "true").otherwise("null"), F.lit('}, "funding": {"status": '), pick(['"full"', '" Partial "', '"none"', "null", '"free"'], 5),
        F.lit('}, "field_match": {"score": '), number(F.col("value") / 100), F.lit('}, "funding_confidence": "'), number(F.col("value") / 200 - 0.1), F.lit('"}'),
    ]
    return table(spark, d, "events").select(k.alias("id"), F.concat(*parts).alias("raw"))


@query(f"""select id, json_extract_string(raw, '$.page_type') as page_type, {_FLAG('$.position.exists')} as position_exists, {_FLAG('$.position.is_expired')} as is_expired,
  array_to_string(list_filter({_MAPPED}, lambda v, i: list_position({_MAPPED}, v) = i), ' ') as levels, case when {_STATUS} in ('full', 'partial', 'none') then {_STATUS} else 'unclear' end as status,
  round({_NUMBER('$.field_match.score')}, 6) as score, round({_NUMBER('$.funding_confidence')}, 6) as confidence
 from (select -1 as id, raw from {values(_RAW, 'raw')} union all select event_id, {_MADE} from events)""")
def decision_normalize(spark, d):
    n = frame(spark, _RAW, "raw string").select(F.lit(-1).cast("bigint").alias("id"), "raw").unionAll(_made_decisions(spark, d))
    n = n.select("id", "raw", dc.normalised(F.col("raw")).alias("d"))
    page_type = F.when(F.get_json_object("raw", "$.page_type").isNotNull(), F.col("d.page_type"))
    return n.select("id", page_type.alias("page_type"), "d.position_exists", "d.is_expired", F.array_join("d.degree_levels", " ").alias("levels"), F.col("d.funding_status").alias("status"), F.round("d.field_score", 6).alias("score"), F.round("d.funding_confidence", 6).alias("confidence"))


# --- verification and rules --------------------------------------------------------------------------------------

_SHOWN = ["ada byron", "mary lee", "we are x@y.z", "a@b.c"]
_CLAIMS = [(n, e) for n in ("Dr. Ada Byron", "Bob Ray", "Mary Lee") for e in ("a@b.c", " A@B.c ", "q@b.c", "", None)]
_CLAIM_SQL = f"select row_number() over () as k, name, email from {values(_CLAIMS, 'name, email')}"


@query(f"""select name, coalesce(email, '-') as email, contains('ada byron and mary lee', lower(regexp_replace(name, 'Dr[.] ', ''))) as person,
 case when contains('ada byron and mary lee', lower(regexp_replace(name, 'Dr[.] ', ''))) and (coalesce(email, '') = '' or list_contains(['a@b.c', 'x@y.z'], lower(trim(email)))) then email end as kept,
 case when contains('ada byron and mary lee', lower(regexp_replace(name, 'Dr[.] ', ''))) and coalesce(email, '') <> '' and not list_contains(['a@b.c', 'x@y.z'], lower(trim(email))) then email end as dropped from ({_CLAIM_SQL})""")
def email_whitelist(spark, d):
    """People and addresses that a page does not show are dropped from a decision about it."""
    claims = frame(spark, _CLAIMS, "name string, email string")
    raw = F.to_json(F.struct(F.array(F.struct("name", "email")).alias("people")))
    n = claims.withColumn("d", dc.normalised(raw))
    page = F.lit("ada byron and mary lee")
    checked, found = dc.verified(n["d"], page, page, F.array(F.lit("a@b.c"), F.lit("x@y.z")))
    out = n.select("name", F.coalesce("email", F.lit("-")).alias("email"), checked.alias("c"), found.alias("f"))
    return out.select("name", "email", (F.size("c.people") > 0).alias("person"), F.get("c.people", F.lit(0))["email"].alias("kept"), F.get("f.dropped_emails", F.lit(0)).alias("dropped"))


_RULED = list(
    itertools.product(
        (True, False),
        ("full", "partial", "none", "unclear"),
        (["phd"], ["postdoc"], []),
        ("2020-01-01", "2030-01-01T09", "soon", None),
        (0.6, 0.59),
        ("is fully funded by us", "not there at all"),
        (["optics"], ["Lasers and light"]),
        ("Ada Byron", None),
    )
)
_RULED_ROWS = [(k, *r) for k, r in enumerate(_RULED)]
_RULED_NAMES = "k, open, status, levels, deadline, number, quote, topics, person"
_STRICT = dc.Profile(["optics"], [], ["lasers"], accept_partial=False)
_REASONS = """[case when not open then 'no_open_position' end, case when open and quote <> 'is fully funded by us' then 'position_evidence_not_on_page' end,
  case when open then case when len(levels) = 0 then 'degree_level_unknown' when not list_contains(levels, 'phd') then 'degree_level_not_targeted' end end,
  case when try_cast(left(deadline, 10) as date) < date '2025-06-01' then 'expired' end,
  case status when 'none' then 'no_funding' when 'partial' then 'partial_funding_not_accepted' when 'unclear' then 'funding_unclear' end,
  case when status in ('full', 'partial') and quote <> 'is fully funded by us' then 'funding_evidence_not_on_page' end,
  case when status in ('full', 'partial') and number < 0.6 then 'low_funding_confidence' end, case when number < 0.6 then 'off_field' end,
  case when contains(lower(array_to_string(topics, ' ')), 'lasers') then 'excluded_topic' end, case when person is null then 'no_person_identified' end]"""


@query(f"select k, array_to_string(list_filter({_REASONS}, lambda r: r is not null), ' ') as reasons from {values(_RULED_ROWS, _RULED_NAMES)}")
def keep_rules(spark, d):
    """Reasons against every combination of what a decision can say."""
    rows = frame(spark, _RULED_ROWS, "k int, open boolean, status string, levels array<string>, deadline string, number double, quote string, topics array<string>, person string")
    people = F.filter(F.array(F.struct(F.col("person").alias("name"))), lambda p: p["name"].isNotNull())
    position = F.struct(F.col("open").alias("exists"), F.col("levels").alias("degree_levels"), "deadline", F.col("quote").alias("evidence_quote"))
    funding = F.struct("status", F.col("quote").alias("evidence_quote"))
    raw = F.to_json(F.struct(position.alias("position"), funding.alias("funding"), F.struct(F.col("number").alias("score"), F.col("topics").alias("matched_topics")).alias("field_match"), F.col("number").alias("funding_confidence"), people.alias("people")))
    n = rows.select("k", dc.normalised(raw).alias("d"))
    page = F.lit("ada byron has an open position here; it is fully funded by us")
    checked, quotes = dc.verified(n["d"], page, page, F.array().cast("array<string>"))
    return n.select("k", F.array_join(dc.rule_reasons(checked, quotes, _STRICT, "2025-06-01"), " ").alias("reasons"))


# --- the classifier ----------------------------------------------------------------------------------------------


class _Stub:
    """Fails on every 7th question, answers garbage to every 5th, an empty decision to the rest."""

    name, model = "stub", "1"

    def score(self, questions: DataFrame) -> DataFrame:
        k = F.regexp_extract("user", r'"url":"u([0-9]+)"', 1).cast("bigint")
        answer = F.when(k % 7 != 0, F.when(k % 5 == 0, 'no {"json').otherwise('Here: {"summary": "s", "people": [{"name": "Ada Byron"}]}'))
        long = F.lit(1).cast("bigint")
        return questions.withColumns({"reply": answer, "error": F.when(k % 7 == 0, "HTTP 500"), "input_tokens": long, "output_tokens": long})


_BUDGET = 30


@query(f"""select doc_id, cached, case when not cached and asked > {_BUDGET} then 'llm_budget_exhausted' when not cached and doc_id % 7 = 0 then 'llm_error' when not cached and doc_id % 5 = 0 then 'invalid_llm_output'
  else 'no_open_position funding_unclear off_field no_person_identified' end as reasons, case when not cached and asked > {_BUDGET} then 0 when cached then 0 else 1 end::bigint as calls
 from (select doc_id, doc_id % 4 = 0 as cached, sum(case when doc_id % 4 = 0 then 0 else 1 end) over (partition by source order by doc_id) as asked from documents)""")
def classifier_outcomes(spark, d):
    """What becomes of each page: from the cache, over the budget, failed, unreadable, or judged by the rules."""
    docs = table(spark, d, "documents")
    empty = F.array().cast("array<string>")
    signals = F.struct(*(empty.alias(c) for c in ("position", "funding", "negative", "degrees", "fields")))
    pages = docs.select(F.col("source").alias("university"), F.col("doc_id").alias("visit"), F.concat(F.lit("u"), "doc_id").alias("url"), F.lit("other").alias("kind"), F.lit("t").alias("title"), F.left("text", F.lit(300)).alias("text"), empty.alias("emails"), F.create_map().cast("map<string,array<string>>").alias("profile_links"), signals.alias("signals"))
    profile = dc.Profile(["nothing"])
    keys = cl.asked(pages, profile, _Stub(), "2025-06-01").where("visit % 4 = 0")
    cache = keys.select("cache_key", F.lit('{"people": [{"name": "Bob Ray"}]}').alias("reply"))
    out = cl.classified(pages, profile, _Stub(), today="2025-06-01", cache=cache, budget=_BUDGET)
    return out.select(F.col("visit").alias("doc_id"), "cached", F.array_join("reasons", " ").alias("reasons"), (F.col("allowed") & ~F.col("cached")).cast("bigint").alias("calls"))


_FORMS = ["gemini", "anthropic", "chat"]
_BODY = """case form when 'gemini' then case when conv_id % 5 = 0 then '{"promptFeedback": {"blockReason": "SAFETY"}}' when conv_id % 7 = 0 then '{}' else '{"candidates": [{"content": {"parts": [{"text": "hm", "thought": true}, {"text": "' || role || '"}, {"text": "-' || turn || '"}]}, "finishReason": "STOP"}], "usageMetadata": {"promptTokenCount": ' || turn || ', "candidatesTokenCount": 3}}' end
 when 'anthropic' then '{"model": "m", "content": [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "' || role || '"}, {"type": "text", "text": "-' || turn || '"}], "usage": {"input_tokens": ' || turn || '}, "stop_reason": "end"}'
 else case when conv_id % 5 = 0 then '{"error": "overloaded"}' when conv_id % 7 = 0 then '{"choices": []}' else '{"model": "c", "choices": [{"message": {"content": "' || role || '-' || turn || '"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": ' || turn || ', "completion_tokens": 3}}' end end"""
_FAILED = "case when form <> 'anthropic' and conv_id % 5 = 0 then 1 when form <> 'anthropic' and conv_id % 7 = 0 then 2 else 0 end"


@query(f"""select conv_id, turn, form, case when bad = 0 then role || '-' || turn end as text, case when bad = 0 and form <> 'gemini' then left(form, 1) end as first, case when bad > 0 then 0 else turn end as given, case when bad > 0 or form = 'anthropic' then 0 else 3 end::bigint as made,
 case when bad = 0 then case form when 'gemini' then 'STOP' when 'anthropic' then 'end' else 'stop' end end as finish,
 case when bad = 1 then case form when 'gemini' then 'blocked: SAFETY' else 'error: overloaded' end when bad = 2 then case form when 'gemini' then 'no candidates' else 'no choices' end end as error, case when bad > 0 then not (form = 'gemini' and bad = 1) end as retryable
 from (select *, {_FAILED} as bad from conversations, (select unnest({literal(_FORMS)}) as form))""")
def provider_replies(spark, d):
    """Replies in three wire formats, read alike."""
    c = table(spark, d, "conversations").select("*", F.explode(F.array(*map(F.lit, _FORMS))).alias("form"))
    c = c.select("conv_id", "turn", "form", F.expr(_BODY).alias("body"))
    r = c.select("conv_id", "turn", "form", rp.parsed(F.col("form"), F.col("body")).alias("r"))
    model = F.when(F.col("r.model") == "m", "a").when(F.col("r.model") == "c", "c")
    return r.select("conv_id", "turn", "form", "r.text", model.alias("first"), F.col("r.input_tokens").alias("given"), F.col("r.output_tokens").alias("made"), F.col("r.finish_reason").alias("finish"), "r.error", "r.retryable")


_ERRORS = [(s, b, a) for s in (400, 401, 403, 404, 429, 500, 503) for b in ('{"error": {"message": "Bad region"}}', '{"error": "plain"}', "<html>down", '{"other": 1}') for a in ("7", "later", None)]
_SAID = "case when json_valid(body) then coalesce(json_extract_string(body, '$.error.message'), case when json_type(json_extract(body, '$.error')) = 'VARCHAR' then json_extract_string(body, '$.error') end, left(body, 400)) else left(body, 400) end"


@query(f"""select status, body, header, status = 429 or status >= 500 as retryable, {_SAID} as message, try_cast(header as double) as retry_after,
 case when status in (401, 403) and contains(lower({_SAID}), 'region') then 'not offered at this location: try another provider' when status in (401, 403) then 'check the key' when status = 404 then 'check the name of the model' when status = 429 then 'lower the requests per minute, or wait' end as hint
 from {values(_ERRORS, 'status, body, header')}""")
def provider_errors(spark, d):
    e = frame(spark, _ERRORS, "status int, body string, header string")
    return e.select("status", "body", "header", rp.error_class(F.col("status"), F.col("body"), F.col("header")).alias("e")).select("status", "body", "header", "e.*")


# --- records -----------------------------------------------------------------------------------------------------

_PEOPLE = "'[{\"name\": \"A ' || role || '\", \"role\": ' || case when conv_id % 3 = 0 then '\"author\"' when conv_id % 3 = 1 then 'null' else '\"contact\"' end || '}, {\"name\": \"B\", \"department\": \"Own\", \"email\": \"b@x.org\", \"role\": \"' || case when turn % 2 = 0 then 'author' else 'supervisor' end || '\"}]'"


@query(f"""with p as (select conv_id * 100 + turn as visit, json_extract(people, '$[*]') as ps from (select conv_id, turn, {_PEOPLE} as people from conversations)),
 chosen as (select visit, list_filter(ps, lambda x: coalesce(json_extract_string(x, '$.role'), 'supervisor') in ('supervisor', 'contact')) as fit, ps from p),
 rows as (select visit, unnest(ps_) as x, generate_subscripts(ps_, 1) - 1 as k, len(ps_) as n from (select visit, case when len(fit) > 0 then fit else ps end as ps_ from chosen))
 select visit * {en.SEQ} + k as seq, json_extract_string(x, '$.name') as name, coalesce(json_extract_string(x, '$.department'), 'Dept') as department, coalesce(json_extract_string(x, '$.email'), '') as email,
  case when n = 1 then 'https://github.com/a' else '' end as github, 's' as position_evidence, visit::varchar as source_urls from rows""")
def records_explode(spark, d):
    """A record for every selected person of a decision."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("visit"), F.expr(_PEOPLE.replace("'[{", "'{\"position\": {\"evidence_quote\": \"s\"}, \"people\": [{").replace("}]'", "}]}'")).alias("raw"))
    links = F.create_map(F.lit("github"), F.array(F.lit("https://github.com/a")))
    kept = c.select(F.lit("u").alias("university"), "visit", F.col("visit").cast("string").alias("url"), F.lit("Dept").alias("section"), links.alias("profile_links"), dc.normalised(F.col("raw")).alias("d"))
    out = en.records(kept)
    joined = lambda c: F.array_join(c, "|").alias(c)
    return out.select("seq", "name", "department", "email", joined("github"), joined("position_evidence"), joined("source_urls"))


def _people(spark, d) -> DataFrame:
    """conversations as records: a conversation's turns name one person, half of them by address."""
    c = table(spark, d, "conversations")
    letter = F.translate((F.col("conv_id") % 7).cast("string"), "0123456", "abcdefg")
    turn = F.col("turn")
    return c.select(
        F.lit("u").alias("university"),
        (F.col("conv_id") * 1000 + turn).alias("seq"),
        F.concat(F.lit("Dr. Name "), letter).alias("name"),
        F.when(turn % 4 == 1, F.concat(F.lit("Title "), turn.cast("string"))).otherwise("").alias("title_role"),
        F.when(turn % 2 == 0, F.concat(F.lit("M"), (F.col("conv_id") % 11).cast("string"), F.lit("@x.org"))).otherwise("").alias("email"),
        F.col("role").alias("rationale"),
        F.when(turn % 3 == 0, "full").when(turn % 3 == 1, "none").otherwise("").alias("funding_status"),
        (turn % 10 / 10).alias("field_match_score"),
        F.array(F.col("role"), (turn % 3).cast("string"), F.lit("")).alias("matched_topics"),
        F.array((F.col("conv_id") % 13).cast("string")).alias("source_urls"),
        F.col("role").alias("llm_model"),
    )


_MERGE = """with r as (select conv_id * 1000 + turn as seq, conv_id, turn, role, 'name ' || translate((conv_id % 7)::varchar, '0123456', 'abcdefg') as k, case when turn % 2 = 0 then 'm' || (conv_id % 11) || '@x.org' end as e,
   case when turn % 4 = 1 then 'Title ' || turn end as title, case turn % 3 when 0 then 'full' when 1 then 'none' else '' end as status, (turn % 10) / 10.0 as score from conversations),
 mail as (select e, min(seq) as f, arg_min(k, seq) as k from r where e is not null group by e),
 anchor as (select k, min(f) as f from (select k, f from mail union all select k, min(seq) from r where e is null group by k) group by k),
 x as (select r.*, coalesce(mail.f, anchor.f) as entity from r left join mail on r.e = mail.e left join anchor on r.e is null and r.k = anchor.k),
 topics as (select entity, v, min(seq * 10 + i) as place from (select entity, seq, unnest([role, (turn % 3)::varchar]) as v, generate_subscripts([1, 2], 1) as i from x) group by entity, v),
 firsts as (select entity, role, min(seq) as place from x group by entity, role),
 says as (select entity, string_agg(role, ' / ' order by place) as rationale from firsts group by entity),
 urls as (select entity, (conv_id % 13)::varchar as v, min(seq) as place from x group by entity, conv_id % 13)"""


@query(f"""{_MERGE} select entity as seq, count(*) as records, arg_min('Dr. N' || substr(k, 2), seq) as name, coalesce(arg_min(e, seq) filter (e is not null), '') as email, coalesce(arg_min(title, seq) filter (title is not null), '') as title_role,
  case when bool_or(status = 'full') then 'full' when bool_or(status = 'none') then 'none' else '' end as funding_status, max(score)::double as field_match_score, arg_min(role, seq) as llm_model,
  (select string_agg(v, '|' order by place) from topics t where t.entity = x.entity) as matched_topics, (select string_agg(v, '|' order by place) from urls u where u.entity = x.entity) as source_urls,
  (select rationale from says s where s.entity = x.entity) as rationale from x group by entity""")
def entity_merge(spark, d):
    """One record per person, every column."""
    people = _people(spark, d)
    sizes = en.with_entity(people).groupBy(F.col("entity").alias("seq")).agg(F.count("*").alias("records"))
    joined = lambda c: F.array_join(F.filter(c, lambda v: v != ""), "|").alias(c)
    out = en.merged(people).join(sizes, "seq")
    return out.select("seq", "records", "name", F.lower("email").alias("email"), "title_role", "funding_status", "field_match_score", "llm_model", joined("matched_topics"), joined("source_urls"), "rationale")


@query(f"""{_MERGE}, m as (select entity, max(score) as s, arg_min('Dr. N' || substr(k, 2), seq) as name from x group by entity)
 select entity as seq, row_number() over (order by s desc, name, entity) as rank from m""")
def record_order(spark, d):
    """Place of each merged record in the report."""
    m = en.merged(_people(spark, d)).withColumn("funding_confidence", F.lit(0.0))
    return en.numbered(m).select("seq", F.col("rank").cast("bigint").alias("rank"))


_PERSON = "<html lang='en'><head><title>{0}</title></head><body><article><h1>{0}</h1><p>{1}</p></article></body></html>"
_ADA = "Prof. Ada Byron studies that erthth and its ways, and has done so in many places over many years. We offer thble work to a doctoral student in this group. The post comes with a contract and is fully funded. Write to ada@byron.example.org at any time of the year."
_BOB = "Dr. Bob Carter studies that erthth as well, in the same house and on the same floor, and gives lessons. We offer thble work to a master student in this group. The post comes with nothing but good company over there. Write to bob@carter.example.org at any time."
SITE = [(-1, "https://mini.example.org/people/ada", _PERSON.format("Prof. Ada Byron", _ADA)), (-2, "https://mini.example.org/jobs/1", _PERSON.format("Open position", _ADA)), (-3, "https://mini.example.org/people/bob", _PERSON.format("Dr. Bob Carter", _BOB))]


def _evaluated(spark, d):
    pages = table(spark, d, "pages").unionByName(frame(spark, SITE, "page_id long, url string, html string"))
    return pl.evaluate(pages, PROFILE, today="2025-06-01", terms=TERMS)


@query()
def decision_pipeline(spark, d):
    """Flagship: the pages and a small fictional site, to merged records."""
    return _evaluated(spark, d)[0]


@query()
def record_cells(spark, d):
    return sinks.cells(decision_pipeline(spark, d))


# The pages without the small site, whose people the synthetic texts never name: every accepted page is dropped by a rule.
_ACCEPTED = "('position_page', 'profile_with_field_terms', 'position_terms_with_funding_or_field', 'profile_mentions_openings')"
_SEEN = f"select *, {PREFILTER} as prefilter, {CANON} as canonical from ({ANALYSED})"
_CUT = "(select page_id, canonical, kind, case when length(text) <= 12000 then text else left(text, 9600) || chr(10) || '[... truncated ...]' || chr(10) || right(text, 2400) end as text from seen where prefilter in " + _ACCEPTED + ")"
_FIELDS = [*PROFILE.target_fields, *PROFILE.keywords]
_JUDGED = scored_sql("cut", "page_id, canonical, kind").replace(literal(FIELDS), literal([f.lower() for f in _FIELDS]))
_OWN = f"""list_filter([case when post is null then 'no_open_position' end, case when post is not null and length(trim({match_form('post')}, ' ."''')) < 8 then 'position_evidence_not_on_page' end,
 case when post is not null then case when len(levels) = 0 then 'degree_level_unknown' when not list_contains(levels, 'phd') then 'degree_level_not_targeted' end end,
 case status when 'none' then 'no_funding' end, case when status in ('full', 'partial') and length(trim({match_form('funding_quote')}, ' ."''')) < 8 then 'funding_evidence_not_on_page' end,
 case when score < 0.3 then 'off_field' end, case when person = '' then 'no_person_identified' end], lambda r: r is not null)"""


@query(f"""with seen as ({_SEEN}), cut as (select * from {_CUT}),
 judged as (select page_id, canonical, kind, score, status, {_OWN} as reasons from ({_JUDGED}))
 select canonical as url, kind as page_kind, 'prefilter' as stage, prefilter as reasons, left(title, 200) as summary, null::double as score, null::varchar as status from seen where prefilter not in {_ACCEPTED} and (position or funding)
 union all select canonical, kind, 'rules', array_to_string(reasons, ' '), 'deterministic decision', round(score, 6), status from judged where len(reasons) > 0""")
def page_rejections(spark, d):
    """Why pages were dropped: by the prefilter although they showed a signal, or by the rules."""
    rejected = pl.evaluate(table(spark, d, "pages"), PROFILE, today="2025-06-01", terms=TERMS)[1]
    return rejected.select("url", "page_kind", "stage", F.array_join("reasons", " ").alias("reasons"), "summary", F.round("field_match_score", 6).alias("score"), F.col("funding_status").alias("status"))

