"""Robots rules, guard, spacing, budgets and frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ...functions import lexicons as lx, urls
from ...operators import crawl, html, replay, robots as rb
from ...sources import config
from ...sources.shared import stored
from ...sources.snapshots import table
from .base import CANON, HOST, ORIGIN, PATH, QUERY, any_of, frame, link_score as score_sql, literal, query, values
from .pages import FOLLOWED

# --- robots ------------------------------------------------------------------------------------------------------

_OWN_ROBOTS = [
    ("https://a.example", 200, "User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 3\nSitemap: https://a.example/s.xml\n"),
    ("https://b.example", 200, "Sitemap: /s.xml\nUser-agent: pagebot/1.0\nUser-agent: other\nDisallow: /*.pdf$\nDisallow:\nCrawl-delay: x\nCrawl-delay: 7 # slow\nUser-agent: *\nDisallow: /\n"),
    ("https://c.example", 503, ""),
    ("https://d.example", 404, "User-agent: *\nDisallow: /"),
    ("https://e.example", 200, "Disallow: /early\r\nuser-agent: *\r\nallow: /a%20b*c\r\ndisallow: a\r\n\r\nUser-Agent: PageBot\r\nSitemap: /x\r\nDisallow: /q?x=*&y\r\nUser-agent: pagebot\r\nCrawl-delay: 130\r\nAllow: /q?x=1\r\n"),
]
_PATHS = ["/private/x", "/private/open/y", "/", "/a.pdf", "/a.pdf?x=1", "/robots.txt", "/a%20bzzc", "/early", "/q?x=1&y=2", "/q?x=2&y", "/x/12"]
_OWN_URLS = [(f"{o}{p}",) for o, _, _ in _OWN_ROBOTS for p in _PATHS]
# Every host of the pages has a file of its own, made of its name.
_SITES = f"select distinct {ORIGIN} as origin from pages"
_SITE_BODY = "'User-agent: ' || case length(origin) % 3 when 0 then 'pagebot' else '*' end || chr(10) || 'Disallow: /' || substr('deenfres', length(origin) % 4 * 2 + 1, 2) || '/' || chr(10) || 'Allow: /*1' || chr(10) || 'Disallow: /*page=2' || chr(10)"
_FILES_SQL = f"select origin, status, body from {values(_OWN_ROBOTS, 'origin, status, body')} union all select origin, case when length(origin) % 7 = 0 then 500 else 200 end, {_SITE_BODY} from ({_SITES})"


def _files(spark, d) -> DataFrame:
    sites = table(spark, d, "pages").select(urls.origin_of(F.col("url")).alias("origin")).distinct()
    own = frame(spark, _OWN_ROBOTS, "origin string, status int, body string")
    n = F.length("origin")
    lines = [F.concat(F.lit("User-agent: "), F.when(n % 3 == 0, "pagebot").otherwise("*")), F.concat(F.lit("Disallow: /"), F.substring(F.lit("deenfres"), n % 4 * 2 + 1, F.lit(2)), F.lit("/")), F.lit("Allow: /*1"), F.lit("Disallow: /*page=2")]
    made = sites.select("origin", F.when(n % 7 == 0, 500).otherwise(200).alias("status"), F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("body"))
    return own.unionByName(made)


def _urls(spark, d) -> DataFrame:
    return frame(spark, _OWN_URLS, "url string").unionAll(table(spark, d, "pages").select("url"))


# Lines with their group: a group begins at an agent line that follows no other (sitemap lines aside).
_KEYS = "select origin, k, lower(trim(split_part(line, ':', 1))) as key, trim(substr(line, strpos(line, ':') + 1)) as value from (select origin, k, regexp_replace(raw, '#.*$', '') as line from (select origin, unnest(string_split_regex(body, '\\r\\n|\\n|\\r')) as raw, generate_subscripts(string_split_regex(body, '\\r\\n|\\n|\\r'), 1) as k from files where status between 200 and 299)) where contains(line, ':')"
_GROUPED = f"""files as ({_FILES_SQL}), keys as ({_KEYS}),
 grouped as (select *, sum(case when key = 'user-agent' and coalesce(before, '') <> 'user-agent' then 1 else 0 end) over (partition by origin order by k) as g
  from (select *, lag(key) over (partition by origin order by k) as before from keys where key <> 'sitemap')),
 agents as (select distinct origin, g, lower(trim(split_part(value, '/', 1))) as agent from grouped where key = 'user-agent'),
 delays as (select origin, g, arg_max(try_cast(value as double), k) as delay from grouped where key = 'crawl-delay' and try_cast(value as double) >= 0 group by origin, g),
 rules as (select origin, g, k, key = 'allow' as allow, case when regexp_matches(value, '^[/*]') then value else '/' || value end as pattern from grouped where key in ('allow', 'disallow') and value <> '' and g > 0),
 named as (select origin, bool_or(agent = 'pagebot') as named from agents group by origin),
 chosen as (select a.origin, a.g, a.agent from agents a join named n using (origin) where a.agent = case when n.named then 'pagebot' else '*' end),
 delay as (select c.origin, max(d.delay) as crawl_delay from chosen c left join delays d on c.origin = d.origin and c.g = d.g group by c.origin),
 lines as (select distinct c.origin, c.agent, r.k, r.allow, r.pattern, delay.crawl_delay from chosen c join delay on c.origin = delay.origin left join rules r on c.origin = r.origin and c.g = r.g)"""


@query(f"with {_GROUPED} select origin, agent, allow, pattern, crawl_delay from lines")
def robots_parse(spark, d):
    """The rules that hold for the crawler, of every file."""
    rules = rb.chosen_rules(rb.parsed_rules(_files(spark, d).where("status = 200")), "pagebot")
    return rules.select("origin", "agent", "allow", "pattern", "crawl_delay")


_DECODED = "url_decode(replace({x}, '+', '%2B'))"
_REGEX = f"'(?s)^' || replace(regexp_escape({_DECODED.replace('{x}', chr(39).join(['regexp_replace(pattern, ', '[$]$', ', ', '', ')']))}), '\\*', '.*') || case when suffix(pattern, '$') then '$' else '' end"
_TARGET = _DECODED.replace("{x}", f"({PATH}) || case when {QUERY} = '' then '' else '?' || {QUERY} end")


@query(f"""with {_GROUPED}, wanted as (select url, {ORIGIN} as origin, ({PATH}) = '/robots.txt' as itself, {_TARGET} as target from (select url from {values(_OWN_URLS, 'url')} union all select url from pages)),
 best as (select w.url, arg_max({{'allow': l.allow, 'pattern': l.pattern}}, (strlen(l.pattern), l.allow, -l.k)) as b from (select distinct * from wanted) w join lines l on w.origin = l.origin and l.pattern is not null and regexp_matches(w.target, {_REGEX.replace('pattern', 'l.pattern')}) group by w.url),
 policy as (select origin, case when status between 200 and 299 then 'parsed' when status in (0, 401, 403, 429) or status >= 500 then 'disallow_all' else 'allow_all' end as mode from files),
 maps as (select origin, list(value order by k)[1:5] as sitemaps from keys where key = 'sitemap' and value <> '' group by origin)
 select w.url, case when itself then true when mode = 'disallow_all' then false when mode = 'allow_all' then true else coalesce(b.allow, true) end as allowed,
  case when not itself and mode = 'parsed' then b.pattern end as rule, crawl_delay, greatest(2.0, coalesce(crawl_delay, 0)) as effective_delay,
  coalesce((select any_value(agent) from chosen c where c.origin = w.origin), 'none') as grp, coalesce(array_to_string(sitemaps, ' '), '') as sitemaps
 from wanted w left join policy using (origin) left join best using (url) left join delay using (origin) left join maps using (origin)""")
def robots_check(spark, d):
    """Whether each URL may be asked for, by which rule, whose rules, and how slowly."""
    wanted = _urls(spark, d).withColumn("origin", urls.origin_of(F.col("url")))
    out = rb.explained(wanted, _files(spark, d), "pagebot")
    return out.select("url", "allowed", "rule", "crawl_delay", "effective_delay", "grp", F.coalesce(F.array_join("sitemaps", " "), F.lit("")).alias("sitemaps"))


@query(f"select distinct {ORIGIN} as origin, {ORIGIN} || '/robots.txt' as robots_url from pages")
def robots_lookups(spark, d):
    """One lookup per origin."""
    return rb.origins(table(spark, d, "pages"))


_STATUS = [(s,) for s in (0, 200, 204, 301, 401, 403, 404, 410, 429, 500, 503)]


@query(f"select status, case when status between 200 and 299 then 'parsed' when status in (0, 401, 403, 429) or status >= 500 then 'disallow_all' else 'allow_all' end as mode from {values(_STATUS, 'status')}")
def robots_status_policy(spark, d):
    return frame(spark, _STATUS, "status int").select("status", rb.policy_mode(F.col("status")).alias("mode"))


_DELAYS = [("a", 1.0, None), ("b", 3.0, 2.5), ("c", None, 7.0), ("d", 0.0, 0.0)]


@query(f"select host, greatest(2.0, coalesce(conf, 0), coalesce(crawl, 0))::double as delay from (select host, conf::double as conf, crawl::double as crawl from {values(_DELAYS, 'host, conf, crawl')} union all select event_id::varchar, value / 10, case when user_id % 3 = 0 then value / 7 end from events)")
def effective_delay(spark, d):
    own = frame(spark, _DELAYS, "host string, conf double, crawl double")
    events = table(spark, d, "events").select(F.col("event_id").cast("string"), F.col("value") / 10, F.when(F.col("user_id") % 3 == 0, F.col("value") / 7))
    return own.unionAll(events).select("host", rb.effective_delay(F.col("conf"), F.col("crawl")).alias("delay"))


# --- gate and guard ----------------------------------------------------------------------------------------------

_BODIES = [(None, "please verify you are human", 200), ("challenge", "", 200), (None, "fine", 403), (None, "Just a moment..." + "x" * 70000, 200), (None, "Just a moment..." + "x" * 70000, 503)]
_MARKED = f"select header, body, status from {values(_BODIES, 'header, body, status')} union all select null, html || case when page_id % 3 = 0 then '<p>Are you a ROBOT' else '' end, [200, 403, 503][page_id % 3 + 1] from pages"


@query(f"""select md5(body) as digest, status, coalesce(header = 'challenge', false)
  or ({any_of(lx.CHALLENGE_MARKERS, 'lower(left(body, 40000))')} and (status in (403, 429, 503) or length(body) < 60000)) as challenged from ({_MARKED})""")
def challenge_detect(spark, d):
    k = F.col("page_id")
    pages = table(spark, d, "pages").select(F.lit(None).cast("string"), F.concat("html", F.when(k % 3 == 0, "<p>Are you a ROBOT").otherwise("")), F.element_at(F.array(F.lit(200), F.lit(403), F.lit(503)), (k % 3 + 1).cast("int")))
    both = frame(spark, _BODIES, "header string, body string, status int").unionAll(pages)
    return both.select(F.md5("body").alias("digest"), "status", crawl.challenged(F.col("header"), F.col("body"), F.col("status")).alias("challenged"))


_STATES = "case event_type when 'error' then 503 when 'signup' then 404 when 'purchase' then case when event_id % 9 = 0 then 429 else 0 end else 200 end"
_ATTEMPTS = f"select user_id::varchar as host, event_id as seq, (event_id % 3)::int as attempt, ({_STATES})::int as status, case when event_id % 2 = 0 then value end as retry_after, event_id % 41 = 0 as challenge from events"


def _attempts(spark, d) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("host"),
        k.alias("seq"),
        (k % 3).cast("int").alias("attempt"),
        F.expr(_STATES).cast("int").alias("status"),
        F.when(k % 2 == 0, F.col("value")).alias("retry_after"),
        (k % 41 == 0).alias("challenge"),
    )


_SERVER = "(a.status = 0 or a.status >= 500)"
_GUARD = f"""with recursive a as (select *, row_number() over (partition by host order by seq) as n from ({_ATTEMPTS})),
 log as (select host, 0::bigint as n, 0::bigint as seq, 0 as attempt, 0 as status, false as stopped, 0 as limited, 0 as streak, '' as reason, null::double as wait from (select distinct host from a)
  union all select a.host, a.n, a.seq, a.attempt, a.status,
   s.stopped or a.challenge or a.status in (401, 403, 407, 451) or (a.status = 429 and s.limited >= 1) or ({_SERVER} and s.streak >= 4),
   s.limited + case when a.status = 429 and not a.challenge then 1 else 0 end,
   case when a.challenge or a.status in (401, 403, 407, 451, 429) then s.streak when {_SERVER} then s.streak + 1 else 0 end,
   case when s.stopped then 'stopped_before' when a.challenge then 'challenge' when a.status in (401, 403, 407, 451) then 'refused' when a.status = 429 and s.limited >= 1 then 'rate_limited_twice'
    when a.status = 429 then 'rate_limited' when {_SERVER} and s.streak >= 4 then 'server_errors' when {_SERVER} and a.attempt < 2 then 'server_error' when {_SERVER} then 'server_error_last'
    when a.status between 400 and 499 then 'client_error' else 'ok' end,
   case when s.stopped or a.challenge then null when a.status = 429 and s.limited = 0 then least(120.0, greatest(2.0, coalesce(a.retry_after, 30.0))) when {_SERVER} and s.streak < 4 and a.attempt < 2 then 10.0 * (a.attempt + 1) end
  from log s join a on a.host = s.host and a.n = s.n + 1)"""
_ACTION = "case when reason in ('stopped_before', 'challenge', 'refused', 'rate_limited_twice', 'server_errors') then 'stop_host' when reason in ('rate_limited', 'server_error') then 'retry' when reason in ('server_error_last', 'client_error') then 'skip_url' else 'ok' end"


@query(f"{_GUARD} select host, seq, attempt, status, {_ACTION} as action, reason, wait::double as wait from log where n > 0")
def guard_replay(spark, d):
    """What the guard says to every attempt of every host."""
    return crawl.guard(_attempts(spark, d))


@query(f"{_GUARD} select host, arg_min(reason, n) as reason from log where n > 0 and {_ACTION} = 'stop_host' group by host")
def guard_stopped(spark, d):
    """Hosts that were stopped, and why."""
    stops = crawl.guard(_attempts(spark, d)).where("action = 'stop_host'")
    return stops.groupBy("host").agg(F.min_by("reason", "seq").alias("reason"))


_OPEN_DOMAINS = ["example.com", "example.org"]
_IN = lambda host: "(" + " or ".join(f"{host} = '{x}' or suffix({host}, '.{x}')" for x in _OPEN_DOMAINS) + ")"
_EXTENSION = f"regexp_extract(regexp_extract(({PATH}), '([^/]*)$', 1), '[^.].*([.][^.]*)$', 1)"


@query(f"""select page_id, case when lower({_EXTENSION}) in ({', '.join(map(literal, lx.NON_HTML))}) then 'skip.non_html_url' when not {_IN(HOST)} then 'skip.out_of_scope' when page_id % 17 = 0 then 'skip.host_stopped'
  when page_id % 13 = 0 then 'robots.disallowed' when page_id % 11 = 0 then 'skip.crawl_delay' when page_id % 10 = 9 then 'host.stopped' when page_id % 9 in (7, 8) then 'skip.http_error'
  when page_id % 7 = 0 and page_id % 2 = 0 then 'skip.redirect_out_of_scope' when page_id % 7 = 0 and page_id % 5 = 0 then 'robots.disallowed_after_redirect' when page_id % 19 = 0 then 'skip.non_html' when page_id % 23 = 0 then 'skip.noindex' else 'page' end as event from pages""")
def page_gate(spark, d):
    """The one reason why a page is skipped, before its request or after it, in the fixed order of the gate."""
    k, url = F.col("page_id"), F.col("url")
    scope = urls.in_scope(urls.host_of(url), _OPEN_DOMAINS)
    first = crawl.before_fetch(url, scope, k % 17 == 0, k % 13 != 0, F.when(k % 11 == 0, 121.0))
    action = F.when(k % 10 == 9, "stop_host").when(k % 9 == 8, "retry").when(k % 9 == 7, "skip_url").otherwise("ok")
    then = crawl.after_fetch(action, k % 7 == 0, k % 2 != 0, k % 5 != 0, k % 19 != 0, k % 23 == 0)
    return table(spark, d, "pages").select("page_id", F.coalesce(first, then, F.lit("page")).alias("event"))


# --- spacing and budgets -----------------------------------------------------------------------------------------

_PAUSE = "case when event_type = 'error' then 10.0 else 0.0 end"


@query(f"""with recursive e as (select user_id, event_id, epoch_us(ts) / 1e6 - 1.7e9 as s, {_PAUSE} as pause, row_number() over (partition by user_id order by event_id) as n from events),
 t as (select user_id, event_id, n, s as start from e where n = 1 union all
  select e.user_id, e.event_id, e.n, greatest(e.s, t.start + 2.0 + e.pause) from t join e on e.user_id = t.user_id and e.n = t.n + 1)
 select user_id, event_id, round(start * 1e6)::bigint as start_micros from t""")
def host_spacing(spark, d):
    """Start of each request of a host: 2 s after the one before, and a pause more where there is one."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    pause = F.when(F.col("event_type") == "error", 10.0).otherwise(0.0)
    r = table(spark, d, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), (micros / 1e6 - 1.7e9).alias("arrival"), pause.alias("pause"))
    # the first request waits for nothing
    r = r.withColumn("pause", F.when(F.col("seq") == F.min("seq").over(Window.partitionBy("host")), 0.0).otherwise(F.col("pause")))
    return crawl.spaced(r, F.lit(2.0)).select(F.col("host").alias("user_id"), F.col("seq").alias("event_id"), F.round(F.col("start") * 1e6).cast("bigint").alias("start_micros"))






@query("select event_id, count(*) over (partition by event_type order by epoch_us(ts) range between 59999999 preceding and current row) as in_window from events")
def rpm_audit(spark, d):
    r = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return crawl.calls_in_last_minute(r, "event_type").select("event_id", "in_window")


@query("""with recursive e as (select event_id, user_id, epoch_us(ts) / 1e6 - 1.7e9 as s, row_number() over (partition by user_id order by event_id) as n from events),
 t as (select user_id, event_id, n, [s] as starts, s as start from e where n = 1 union all
  select user_id, event_id, n, list_append(starts, start)[-3:], start from (
   select e.user_id, e.event_id, e.n, t.starts, case when len(t.starts) >= 3 and t.starts[-3] > greatest(e.s, t.start) - 60 then t.starts[-3] + 60.05 else greatest(e.s, t.start) end as start
   from t join e on e.user_id = t.user_id and e.n = t.n + 1))
 select event_id, round(start * 1e6)::bigint as start_micros from t""")
def rpm_schedule(spark, d):
    """Start of each call when at most three may begin in a minute."""
    r = table(spark, d, "events").select(F.col("user_id").alias("who"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1.7e9).alias("arrival"))
    return crawl.minute_schedule(r, "who", 3).select(F.col("seq").alias("event_id"), F.round(F.col("start") * 1e6).cast("bigint").alias("start_micros"))


@query("select doc_id, (length(text) % 3 = 0) or sum(case when length(text) % 3 = 0 then 0 else 1 end) over (partition by source order by doc_id rows unbounded preceding) <= 20 as allowed from documents")
def llm_budget(spark, d):
    v = table(spark, d, "documents").select("source", "doc_id", (F.length("text") % 3 == 0).alias("cached"))
    return crawl.within_budget(v, "source", "doc_id", 20).select("doc_id", "allowed")


_TRIES = [(a, r) for a in range(0, 9) for r in (None, 7.0)]


@query(f"select attempt, retry_after, case when attempt <= 7 then coalesce(retry_after, least(60.0, pow(2, attempt))) end::double as wait from {values(_TRIES, 'attempt, retry_after')}")
def retry_schedule(spark, d):
    return frame(spark, _TRIES, "attempt int, retry_after double").select("attempt", "retry_after", crawl.retry_schedule(7, F.col("retry_after"), F.col("attempt")).alias("wait"))


# --- frontier ----------------------------------------------------------------------------------------------------

_TERMS = ["th", "one"]


def page_edges(spark, d) -> DataFrame:
    """source, position, url, anchor, score: the pages' own links, and from every page to three others, all of the table's pages."""
    pages = table(spark, d, "pages")
    own = html.page_links(html.parsed(pages)).join(pages.select("page_id", urls.canonical(F.col("url")).alias("source")), "page_id").select("source", (F.col("position") + 3).alias("position"), "url", "anchor")
    n = pages.agg(F.count("*").alias("n"))
    ends = pages.crossJoin(F.broadcast(n)).select(urls.canonical(F.col("url")).alias("source"), F.posexplode(F.array(*((F.col("page_id") * m + k) % F.col("n") for m, k in ((3, 1), (5, 2), (7, 4))))).alias("position", "page_id"))
    more = ends.join(pages.select("page_id", urls.canonical(F.col("url")).alias("url")), "page_id").select("source", "position", "url", F.lit("").alias("anchor"))
    return stored(own.unionByName(more).withColumn("score", urls.link_score(F.col("url"), F.col("anchor"), _TERMS)), "edges")


_EDGES = f"""canon as (select page_id, {CANON} as url from pages), n as (select count(*) as n from pages),
 ends as (select c.url as source, unnest([(c.page_id * 3 + 1) % n, (c.page_id * 5 + 2) % n, (c.page_id * 7 + 4) % n]) as page_id from canon c, n),
 edges as (select source, url, {score_sql(_TERMS)} as score from (
  select c.url as source, f.url, f.anchor from ({FOLLOWED.replace('group by all', 'group by page_id, origin, href')}) f join canon c using (page_id)
  union all select e.source, c.url, '' as anchor from ends e join canon c using (page_id)))"""


def _seeds(spark, d) -> DataFrame:
    pages = table(spark, d, "pages").where("page_id in (0, 5)")
    return pages.select(F.lit("u").alias("university"), F.col("page_id").cast("int").alias("position"), urls.canonical(F.col("url")).alias("url"))


@query(f"""with recursive {_EDGES},
 walk(url, depth) as (select url, 0 from canon where page_id in (0, 5) union select e.url, walk.depth + 1 from walk join edges e on e.source = walk.url where walk.depth < 3),
 first as (select url, min(depth) as depth from walk group by url)
 select f.url, f.depth, case when f.depth = 0 then 100 else (select max(e.score) from edges e join first g on e.source = g.url where e.url = f.url and g.depth = f.depth - 1) end as score from first f""")
def frontier_levels(spark, d):
    """URLs by the level at which a crawl finds them, over the links of all pages."""
    return crawl.frontier_by_level(_seeds(spark, d).select("url"), page_edges(spark, d).select("source", "url", "score"), 3)


@query()
def frontier_exact(spark, d):
    """The order in which a sequential crawl visits pages, best first. Tests compare it with a simulation."""
    links = page_edges(spark, d).withColumn("university", F.lit("u"))
    return crawl.frontier_in_order(_seeds(spark, d), links.select("university", "source", "position", "url", "score"), 100, 6)


def crawl_tables(spark, d) -> dict[str, DataFrame]:
    """Three universities, one per top domain, over the pages as a site; every answer is made of the page's number."""
    pages = table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))
    own = [f"example.{x}" for x in ("com", "org", "net")]
    plans = frame(spark, [(u, 40, 4) for u in own], "university string, max_pages int, max_depth int")
    seeds = frame(spark, [(u, k) for u in own for k in range(12)], "university string, position int")
    seeds = seeds.join(pages.select(F.col("page_id").cast("int").alias("position"), "url"), "position").withColumn("section", F.lit("all"))
    k = F.col("page_id")
    answer = pages.select(
        "url",
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt"),
        F.when(k % 13 == 5, 503).when(k % 17 == 3, 404).when(k % 41 == 7, 403).otherwise(200).alias("status"),
        F.lit(None).cast("double").alias("retry_after"),
        F.lit(False).alias("challenge"),
        F.when(k % 9 == 4, F.concat("url", F.lit("-moved"))).alias("final_url"),
        (k % 8 != 6).alias("is_html"),
        (k % 10 == 2).alias("noindex"),
        (k % 12 == 1).alias("nofollow"),
    )
    # a second and third try succeed for every other page
    answer = answer.withColumn("status", F.when((F.col("attempt") > 0) & (F.col("status") == 503) & (F.length("url") % 2 == 0), 200).otherwise(F.col("status")))
    domains = frame(spark, [(u, u) for u in own], "university string, domain string")
    return {"plans": plans, "seeds": seeds, "fetches": answer, "links": page_edges(spark, d), "domains": domains, "robots": _files(spark, d)}


@query()
def crawl_replay(spark, d):
    """A whole crawl of three sites over the pages: every URL taken from the frontier, and what became of it. Tests compare it with a simulation."""
    t = crawl_tables(spark, d)
    nodes = replay.prepared(t["seeds"], t["fetches"], t["links"], t["domains"], t["robots"], depth=4)
    return replay.replayed(t["plans"], t["seeds"], nodes)


# --- configuration -----------------------------------------------------------------------------------------------

_SECTION = "struct<name: string, kind: string, tags: array<string>, seeds: array<string>>"
_CONFIGS = [
    ("uni-a", "A", 300, 3, 1.0, ["a.example"], [("Chemistry", "department", ["chem"], ["https://a.example/x", "https://www.a.example/y"]), ("Jobs", "jobs", [], ["https://a.example/jobs"])]),
    ("Bad Slug", "B", 5000, 9, 3.0, ["c.example"], [("Law", "department", ["law"], ["https://b.example/"])]),
    ("c", "C", 10, 0, 2.5, ["c.example"], [("Physics", "club", ["Phys"], ["ftp://c.example"]), ("None", "group", ["x"], [])]),
    ("uni-d", "D", None, None, None, [], [("Physics", "department", ["Phys"], ["http://d.example/p"]), ("School", "doctoral_school", [], ["http://d.example/s"]), ("Art", "group", ["art"], ["http://d.example/a"])]),
    ("uni-e", "E", 3000, 6, 2.0, ["E.example"], [("Art", "group", ["art"], ["http://e.example/a"]), ("Music", "group", ["music"], ["http://x.e.example/m"])]),
]
_CONFIG_SQL = "(values " + ", ".join(
    "(" + ", ".join([literal(s), literal(n), f"{literal(p)}::int", f"{literal(dp)}::int", f"{literal(dl)}::double", f"{literal(dm)}::varchar[]"])
    + ", [" + ", ".join(f"{{'name': {literal(a)}, 'kind': {literal(b)}, 'tags': {literal(c)}::varchar[], 'seeds': {literal(e)}::varchar[]}}" for a, b, c, e in ss) + "])"
    for s, n, p, dp, dl, dm, ss in _CONFIGS
) + ") as t(slug, name, max_pages, max_depth, delay, domains, sections)"
_SEED_HOST = "regexp_extract(lower(s), '^https?://([^/?#:]*)', 1)"
_ALL_SEEDS = "flatten(list_transform(sections, lambda x: x.seeds))"
_OUTSIDE = f"len(list_filter({_ALL_SEEDS}, lambda s: regexp_matches(s, '^https?://') and len(list_filter(domains, lambda x: {_SEED_HOST} = lower(x) or suffix({_SEED_HOST}, '.' || lower(x)))) = 0)) > 0"


def _universities(spark) -> DataFrame:
    schema = f"slug string, name string, max_pages int, max_depth int, min_delay_seconds double, allowed_domains array<string>, sections array<{_SECTION}>"
    return frame(spark, _CONFIGS, schema)


@query(f"""select slug, greatest(coalesce(delay, 2.0), 2.0) as delay, concat_ws(' ', case when not regexp_matches(slug, '^[a-z0-9][a-z0-9-]{{1,39}}$') then 'slug' end,
 case when max_pages not between 1 and 3000 then 'max_pages' end, case when max_depth not between 0 and 6 then 'max_depth' end, case when len(domains) = 0 then 'allowed_domains' end,
 case when len(sections) = 0 or len(list_filter(sections, lambda x: len(x.seeds) = 0)) > 0 then 'sections' end,
 case when len(list_filter(sections, lambda x: x.kind not in ('department', 'jobs', 'doctoral_school', 'group'))) > 0 then 'section_kind' end,
 case when len(list_filter({_ALL_SEEDS}, lambda s: not regexp_matches(s, '^https?://'))) > 0 then 'seed_scheme' end, case when {_OUTSIDE} then 'seed_out_of_scope' end) as violations from {_CONFIG_SQL}""")
def config_violations(spark, d):
    return config.violations(_universities(spark))


_EACH = f"select slug, unnest(sections) as s, generate_subscripts(sections, 1) - 1 as i from {_CONFIG_SQL}"
_WANTED = "(s.kind in ('jobs', 'doctoral_school') or list_has_any(list_transform(s.tags, lambda x: lower(x)), ['phys']))"


@query(f"""with m as (select *, {_WANTED} as hit from ({_EACH}))
 select slug, s.name as section, s.kind as kind, seed, (i * 1000 + k - 1)::int as position from (select slug, s, i, unnest(s.seeds) as seed, generate_subscripts(s.seeds, 1) as k from (
  select slug, s, row_number() over (partition by slug order by i) - 1 as i from m where hit or not exists (select 1 from m n where n.slug = m.slug and n.hit)))""")
def section_select(spark, d):
    """Seeds of the sections a profile's tags choose, of all where they choose none."""
    return config.chosen_sections(_universities(spark), ["PHYS"])


@query(f"select slug, s.name as section, s.kind as kind, unnest(s.seeds) as seed from ({_EACH}) order by slug")
def list_sections(spark, d):
    """Universities, their sections and seeds, by slug."""
    return config.chosen_sections(_universities(spark), []).orderBy("slug", "position").select("slug", "section", "kind", "seed")

