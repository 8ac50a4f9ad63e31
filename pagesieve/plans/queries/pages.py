"""URLs and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions import lexicons as lx, urls
from ...operators import crawl, html
from ...sources import snapshots
from ...sources.snapshots import table
from .. import pipeline as pl
from .base import CANON, DOMAINS, FUNDING, HOST, NEGATIVE, ORIGIN, PATH, POSITION, PREFILTER, PROFILE, QUERY, TERMS, any_of, emails, frame, hits, link_score as score_sql, literal, ordered_distinct, query, values


@query(f"select page_id, {CANON} as canonical from pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


_SLUG = f"regexp_replace(left(trim(regexp_replace(lower({PATH}), '[^a-z0-9]+', '-', 'g'), '-'), 40), '-+$', '')"


@query(f"""select page_id, {HOST} as host, {ORIGIN} as origin, ({PATH}) || case when {QUERY} = '' then '' else '?' || {QUERY} end as path_query,
 coalesce(nullif({_SLUG}, ''), 'item') as slug from pages""")
def url_host_origin(spark, d):
    u = F.col("url")
    parts = {"host": urls.host_of(u), "origin": urls.origin_of(u), "path_query": urls.path_and_query(u), "slug": urls.slug(urls.path_of(u))}
    return table(spark, d, "pages").select("page_id", *(v.alias(k) for k, v in parts.items()))


@query(f"select page_id, {HOST} as host from pages where " + " or ".join(f"{HOST} = '{x}' or suffix({HOST}, '.{x}')" for x in DOMAINS))
def scope_filter(spark, d):
    return table(spark, d, "pages").select("page_id", urls.host_of(F.col("url")).alias("host")).where(urls.in_scope(F.col("host"), DOMAINS))


_FILES = [(f"http://a.example{p}",) for p in ("/x.pdf", "/x.PDF?y=1", "/x.html", "/.css", "/dir.css/", "/a.tar.gz", "")]
_EXTENSION = f"regexp_extract(regexp_extract(({PATH}), '([^/]*)$', 1), '[^.].*([.][^.]*)$', 1)"


@query(f"""select url, lower({_EXTENSION}) not in ({', '.join(map(literal, lx.NON_HTML))}) as looks_html
 from (select url from pages union all select url from {values(_FILES, 'url')})""")
def html_path_filter(spark, d):
    both = table(spark, d, "pages").select("url").unionAll(frame(spark, _FILES, "url string"))
    return both.select("url", urls.looks_like_html(F.col("url")).alias("looks_html"))


_KNOWN_HOSTS = ["de.linkedin.com", "www.linkedin.com", "github.com", "www.github.com", "scholar.google.de", "orcid.org", "www.researchgate.net", "dblp.uni-trier.de", "semanticscholar.org", "x.com", "twitter.com", "bsky.app", "example.org"]
_KNOWN_PATHS = ["/in/abc", "/pub/x", "/company/x", "/abc", "/orgs/x", "/a/b", "/a/b/c", "/citations?user=Q1", "/citations?hl=en", "/0000-0001-2345-678X", "/profile/A-B", "/pid/1/2", "/author/1", "/share", "/", "/features"]
_H, _P, _Q = HOST, f"({PATH})", QUERY
_SLASHES = f"length({_P}) - length(replace({_P}, '/', ''))"
_PROFILE_KIND = f"""case when regexp_full_match({_H}, '([a-z]{{2,3}}[.])?linkedin[.]com') then case when starts_with({_P}, '/in/') or starts_with({_P}, '/pub/') then 'linkedin' end
 when {_H} = 'github.com' then case when {_SLASHES} in (1, 2) and trim({_P}, '/') <> '' and not regexp_matches({_P}, '^/(orgs/|topics/|features|about)') then 'github' end
 when regexp_full_match({_H}, 'scholar[.]google[.][a-z.]+') then case when contains({_Q}, 'user=') then 'google_scholar' end
 when {_H} = 'orcid.org' then case when regexp_matches({_P}, '^/[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{3}}[0-9X]') then 'orcid' end
 when {_H} in ('researchgate.net', 'www.researchgate.net') then case when starts_with({_P}, '/profile/') then 'researchgate' end
 when {_H} in ('dblp.org', 'dblp.uni-trier.de') then case when starts_with({_P}, '/pid/') or starts_with({_P}, '/pers/') then 'dblp' end
 when {_H} in ('semanticscholar.org', 'www.semanticscholar.org') then case when starts_with({_P}, '/author/') then 'semantic_scholar' end
 when regexp_full_match({_H}, '(www[.])?(x|twitter)[.]com') then case when {_SLASHES} = 1 and length({_P}) > 1 and substr({_P}, 2) not in ('share', 'intent', 'home', 'search') then 'x' end
 when {_H} = 'bsky.app' then case when starts_with({_P}, '/profile/') then 'bluesky' end end"""
_KNOWN_SQL = f"select url from pages union all select 'https://' || h || p from (select unnest({literal(_KNOWN_HOSTS)}) as h), (select unnest({literal(_KNOWN_PATHS)}) as p)"


@query(f"select url, {_PROFILE_KIND} as kind from ({_KNOWN_SQL})")
def profile_links(spark, d):
    """URLs of the pages, and every known host with every kind of path."""
    known = frame(spark, [(f"https://{h}{p}",) for h in _KNOWN_HOSTS for p in _KNOWN_PATHS], "url string")
    both = table(spark, d, "pages").select("url").unionAll(known)
    return both.select("url", urls.profile_kind(F.col("url")).alias("kind"))


_ANCHORS = ["", "Open positions", "the team", "Vacancies and news"]
_SCORED = [(f"https://a.example{p}", a) for p, a in (("/jobs/phd", ""), ("/~doe/", ""), ("/research/news", "x"), ("/login", "apply now"), ("/x", "thesis news"))]
_SCORED_FIELDS = ["th", "news"]
_ANCHORED = f"select url, {literal(_ANCHORS)}[page_id % 4 + 1] as anchor from pages union all select url, anchor from {values(_SCORED, 'url, anchor')}"


@query(f"select url, anchor, {score_sql(_SCORED_FIELDS)} as score from ({_ANCHORED})")
def link_score(spark, d):
    anchors = F.array(*map(F.lit, _ANCHORS))
    own = table(spark, d, "pages").select("url", F.element_at(anchors, (F.col("page_id") % 4 + 1).cast("int")).alias("anchor"))
    both = own.unionAll(frame(spark, _SCORED, "url string, anchor string"))
    return both.select("url", "anchor", urls.link_score(F.col("url"), F.col("anchor"), _SCORED_FIELDS).alias("score"))


# --- parsing -----------------------------------------------------------------------------------------------------

_ENTITIES = {"&lt;": "<", "&gt;": ">", "&copy;": "©", "&middot;": "·", "&quot;": '"', "&#x27;": "'", "&#39;": "'", "&amp;": "&"}
UNESCAPED = "{x}"
for _k, _v in _ENTITIES.items():
    UNESCAPED = f"replace({UNESCAPED}, {literal(_k)}, {literal(_v)})"


def _plain(x: str) -> str:
    return UNESCAPED.replace("{x}", x)


_TITLE = f"left(trim({_plain('regexp_extract(html, ' + chr(39) + '<title>(.*?)</title>' + chr(39) + ', 1, ' + chr(39) + 's' + chr(39) + ')')}), 300)"
_HEADINGS = f"list_transform(regexp_extract_all(html, '<h[12]>(.*?)</h[12]>', 1, 's')[1:10], lambda t: left(trim({_plain('t')}), 200))"


@query(f"select page_id, {_TITLE} as title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang from pages")
def page_title_lang(spark, d):
    return html.parsed(table(spark, d, "pages")).select("page_id", "title", "lang")


@query(f"select page_id, array_to_string({_HEADINGS}, '|') as headings from pages")
def page_headings(spark, d):
    return html.parsed(table(spark, d, "pages")).select("page_id", F.array_join("headings", "|").alias("headings"))


_A = """'<a href="([^"]*)"[^>]*>([^<]*)</a>'"""
LINKS = f"""select page_id, unnest(regexp_extract_all(html, {_A}, 1)) as href, unnest(regexp_extract_all(html, {_A}, 2)) as anchor,
 generate_subscripts(regexp_extract_all(html, {_A}, 1), 1) - 1 as position, {ORIGIN} as origin from pages"""
FOLLOWED = f"""select page_id, origin || {_plain('href')} as url, arg_min(left(trim({_plain('anchor')}), 200), position) as anchor, min(position)::int as position
 from ({LINKS}) where starts_with(href, '/') group by all"""


@query(f"select page_id, position::int as position, {_plain('href')} as href, left(trim({_plain('anchor')}), 200) as anchor from ({LINKS})")
def page_links(spark, d):
    """All links of a page as they stand."""
    p = html.parsed(table(spark, d, "pages"))
    return p.select("page_id", F.posexplode("links").alias("position", "x")).select("page_id", "position", "x.href", "x.anchor")


@query(f"select page_id, position, url, anchor from (select page_id, position, url, anchor from (select page_id, any_value(position) as position, url, any_value(anchor) as anchor from ({FOLLOWED.replace('group by all', 'group by page_id, origin, href')}) group by page_id, url))")
def page_followable_links(spark, d):
    """Links that a crawl may follow: canonical, each once per page."""
    return html.page_links(html.parsed(table(spark, d, "pages")))


_PUSH = f"select page_id, url, page_id % 5 as depth, page_id % 7 = 0 as nofollow from ({FOLLOWED.replace('group by all', 'group by page_id, origin, href')})"


@query(f"""select page_id, url, ({' or '.join(f"{HOST} = '{x}' or suffix({HOST}, '.{x}')" for x in DOMAINS)}) and lower({_EXTENSION}) not in ({', '.join(map(literal, lx.NON_HTML))})
 and depth < 3 and not nofollow as pushed from ({_PUSH})""")
def link_push(spark, d):
    """Which of the links found at a depth enter the frontier."""
    links = html.page_links(html.parsed(table(spark, d, "pages")))
    depth, nofollow = F.col("page_id") % 5, F.col("page_id") % 7 == 0
    return links.select("page_id", "url", crawl.pushable(F.col("url"), DOMAINS, depth, F.lit(3), nofollow).alias("pushed"))


# Visible text: comments and other tags part strings by a blank, block tags by a line break.
_BLOCK = "|".join(lx.BLOCK_TAGS)
_CLEAN = "regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<(" + "|".join(lx.STRIP_TAGS) + ")[ >].*?</(?:" + "|".join(lx.STRIP_TAGS) + ")>', ' ', 'g')"
_BARE = "regexp_replace(regexp_replace({x}, '(?s)<(?:nav|footer|header|aside)[ >].*?</(?:nav|footer|header|aside)>', ' ', 'g'), '<body[^>]*>', ' ', 'g')"
_MAIN = _CLEAN.replace("{x}", "regexp_extract(html, '(?s)<article>(.*)</article>', 1)")
_BODY = _BARE.replace("{x}", _CLEAN.replace("{x}", "regexp_extract(html, '(?s)<body[^>]*>(.*)(?:</body>|$)', 1)"))
_FLAT = f"trim(regexp_replace({_plain('regexp_replace({x}, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '[ \\t]+', ' ', 'g'))"
_ROOT = f"case when length({_FLAT.replace('{x}', _MAIN)}) > 200 then {_MAIN} else {_BODY} end"
_BROKEN = f"regexp_replace(regexp_replace(root, '</?(?:{_BLOCK}|br)(?: [^>]*)?/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
_LINES = f"list_filter(list_transform(string_split(regexp_replace({_plain(_plain(_BROKEN))}, '[ \\t\\x{{a0}}\\x{{200b}}]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
PAGE_TEXT = f"select * exclude (lines), array_to_string({ordered_distinct('lines')}, chr(10)) as text from (select * exclude (root), {_LINES} as lines from (select *, {_ROOT} as root from pages))"


@query(f"select page_id, text from ({PAGE_TEXT})")
def page_text(spark, d):
    return html.parsed(table(spark, d, "pages")).select("page_id", "text")


def _hit(terms: list[str]) -> str:
    return f"list_has_any(string_split_regex(lower({PATH}), '[^a-z0-9~]+'), {literal(terms)})"


_PEOPLE_LINKS = f"len(list_distinct(list_filter(regexp_extract_all(html, {_A}, 1), lambda h: regexp_matches(lower(h), '/({'|'.join(lx.PERSON_SEGMENTS)})/'))))"
_HEAD_LOW = "lower(title || ' ' || array_to_string(headings[1:3], ' '))"
ANALYSED = f"""select *, case when {_hit(lx.JOBS_PATH)} and position then 'position' when n_emails > 6 or n_people > 12 then 'listing'
  when ({_hit(lx.PEOPLE_PATH)} or contains({PATH}, '/~') or regexp_matches(lower(title), '\\b(prof[.]?|professor|professorin|dr[.]|lecturer)($|[^\\p{{L}}\\p{{N}}_])')) and n_emails <= 3 then 'profile'
  when position and {any_of(lx.POSITION_HINTS, _HEAD_LOW)} then 'position' else 'other' end as kind
 from (select *, len(positions) > 0 as position, len(fundings) > 0 as funding, len(negatives) > 0 as negative, len(fields) > 0 as field
  from (select page_id, url, html, title, headings, text, {_PEOPLE_LINKS} as n_people, len({emails('html')}) as n_emails,
   {hits('title || chr(10) || text', POSITION)} as positions, {hits('title || chr(10) || text', FUNDING)} as fundings, {hits('title || chr(10) || text', NEGATIVE)} as negatives,
   {hits('title || chr(10) || text', PROFILE.terms())} as fields from (select *, {_TITLE} as title, {_HEADINGS} as headings from ({PAGE_TEXT}))))"""


@query(f"select page_id, kind, {PREFILTER} as prefilter from ({ANALYSED})")
def page_kind(spark, d):
    """Kind of every page, and what the prefilter says of it."""
    return pl.prefiltered(pl.analysed(table(spark, d, "pages"), PROFILE, TERMS)).select("page_id", "kind", "prefilter")


@query(f"select page_id, array_to_string({emails('html')}, ' ') as emails from pages")
def page_emails(spark, d):
    p = html.parsed(table(spark, d, "pages"))
    return p.select("page_id", F.array_join(html.emails(p), " ").alias("emails"))


_HEADERS = [("text/html; charset=utf-8", "x", "noindex, nofollow"), ("", "<!DOCTYPE html><p>", "pagebot: NoIndex"), ("application/pdf", "<html>", "all"), ("", "plain", "none")]
_CONTENT = f"select kind, body, tags from {values(_HEADERS, 'kind, body, tags')} union all select ['', 'text/html', 'Application/XHTML+XML; q=1', 'image/png'][page_id % 4 + 1], left(html, 60), ['all', 'noindex', 'other: nofollow', 'none,all'][page_id % 4 + 1] from pages"


@query(f"""select kind, body, tags, lower(trim(string_split(kind, ';')[1])) in ('text/html', 'application/xhtml+xml')
  or (kind = '' and (starts_with(lower(body), '<!doctype html') or starts_with(lower(body), '<html'))) as is_html,
 list_has_any(list_transform(string_split_regex(tags, '[,:]'), lambda x: lower(trim(x))), ['noindex', 'none']) as noindex from ({_CONTENT})""")
def content_type(spark, d):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("page_id") % 4 + 1).cast("int"))
    kinds, tags = ("", "text/html", "Application/XHTML+XML; q=1", "image/png"), ("all", "noindex", "other: nofollow", "none,all")
    own = table(spark, d, "pages").select(pick(*kinds).alias("kind"), F.left("html", F.lit(60)).alias("body"), pick(*tags).alias("tags"))
    both = frame(spark, _HEADERS, "kind string, body string, tags string").unionAll(own)
    return both.select("kind", "body", "tags", html.is_html(F.col("kind"), F.col("body")).alias("is_html"), html.directive(html.robots_tags(F.col("tags")), "noindex").alias("noindex"))


@query("select doc_id, md5(text) as digest from documents")
def body_decode(spark, d):
    """Texts as bytes in four ways of naming their charset, decoded again."""
    k, text = F.col("doc_id") % 4, F.col("text")
    meta = F.lit('<meta charset="utf-8">')
    body = F.when(k == 0, F.encode(text, "UTF-8")).when(k == 1, F.encode(text, "UTF-16LE")).when(k == 2, F.encode(F.concat(meta, text), "UTF-8")).otherwise(F.encode(text, "UTF-16BE"))
    kind = F.when(k == 1, "text/html; charset=utf-16le").when(k == 3, "text/html;charset=UTF-16BE").otherwise("text/html")
    out = html.decoded(body, kind)
    return table(spark, d, "documents").select("doc_id", F.md5(F.replace(out, meta, F.lit(""))).alias("digest"))


_MOST_BYTES = 3000


def _fetches(spark, d) -> DataFrame:
    """pages as a client's answers: every 11th an error, every 13th a redirect too many, every 7th another kind of file."""
    k = F.col("page_id")
    headers = F.create_map(F.lit("Content-Type"), F.when(k % 7 == 0, "application/pdf").otherwise("text/html; charset=utf-8"), F.lit("Retry-After"), k.cast("string"))
    return table(spark, d, "pages").select(
        "page_id",
        "url",
        F.when(k % 5 == 0, 503).otherwise(200).alias("status"),
        headers.alias("headers"),
        F.encode("html", "UTF-8").alias("body"),
        F.when(k % 3 == 0, "https://www.example.org/final").alias("final_url"),
        F.when(k % 13 == 0, 6).otherwise(1).alias("redirects"),
        F.when(k % 11 == 0, F.repeat(F.lit("broken "), 100)).alias("error"),
    )


@query(f"""select page_id, case when lost then 0 when page_id % 5 = 0 then 503 else 200 end as status, case when lost then 0 else least(strlen(html), {_MOST_BYTES}) end::int as bytes,
 not lost and strlen(html) > {_MOST_BYTES} as truncated, case when page_id % 11 = 0 then left(repeat('broken ', 100), 500) when lost then 'too many redirects' end as error,
 case when page_id % 3 = 0 then 'https://www.example.org/final' else {CANON} end as final_url, page_id::double as retry_after, page_id % 7 <> 0 as is_html
 from (select *, page_id % 11 = 0 or page_id % 13 = 0 as lost from pages)""")
def fetch_answers(spark, d):
    """Fetched bytes as a client reads them: cut, errors as status 0, final URL, kind of content."""
    out = snapshots.answers(_fetches(spark, d), max_bytes=_MOST_BYTES, keep=("page_id",))
    return out.select("page_id", F.col("status").cast("int").alias("status"), "bytes", "truncated", "error", "final_url", "retry_after", "is_html")

