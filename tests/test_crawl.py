"""Robots, guard, spacing, frontier and whole crawls, against plain simulations."""

import heapq
import json
import random

import pytest
from pyspark.sql import functions as F

from pagesieve.functions import lexicons as lx, urls
from pagesieve.operators import crawl, replay, robots as rb
from pagesieve.plans import catalog
from pagesieve.plans.queries import crawling
from pagesieve.sources import config, snapshots
from pagesieve.streaming import guard as streaming

SF = "/root/testdata/sf0.001"
ROBOTS = """# comment
User-agent: *
Disallow: /private/
Allow: /private/open
Disallow: /*?sort=
Disallow: /exact$
Disallow: /tie
Allow: /tie
Crawl-delay: 5

User-agent: pagebot
User-agent: otherbot
Disallow: /bots
Disallow: /a%3Cb
Crawl-delay: 2.5
Crawl-delay: nonsense
"""


def checked(spark, paths, body=ROBOTS, status=200, agent="pagebot", host="https://r.example"):
    files = spark.createDataFrame([(host, status, body)], "origin string, status int, body string")
    pages = spark.createDataFrame([(f"{host}{p}",) for p in paths], "url string").withColumn("origin", urls.origin_of(F.col("url")))
    return {r.url.removeprefix(host): r for r in rb.explained(pages, files, agent).collect()}


def test_robots_rules_of_the_star_group(spark):
    got = checked(spark, ["/private/x", "/private/open/x", "/list?sort=a", "/exact", "/exact/more", "/tie", "/else", "/robots.txt"], agent="unnamed")
    allowed = {k: r.allowed for k, r in got.items()}
    assert allowed == {"/private/x": False, "/private/open/x": True, "/list?sort=a": False, "/exact": False, "/exact/more": True, "/tie": True, "/else": True, "/robots.txt": True}
    assert got["/private/open/x"].rule == "/private/open" and got["/else"].rule is None and got["/x" if "/x" in got else "/else"].crawl_delay == 5 and got["/else"].grp == "*"


def test_robots_rules_of_a_named_group(spark):
    got = checked(spark, ["/private/x", "/bots/1", "/a<b", "/a%3cb"])
    assert {k: r.allowed for k, r in got.items()} == {"/private/x": True, "/bots/1": False, "/a<b": False, "/a%3cb": False}
    assert got["/bots/1"].effective_delay == 2.5 and got["/bots/1"].grp == "pagebot"


def test_robots_parsing_rules(spark):
    got = checked(spark, ["/early", "/late", "/no-slash", "/end.pdf", "/end.pdf?x"], body="Disallow: /early\nUser-agent: pagebot/2.0\nSitemap: /s\nUser-agent: z\nDisallow:\nDisallow: no-slash\nDisallow: *.pdf$\n")
    assert {k: r.allowed for k, r in got.items()} == {"/early": True, "/late": True, "/no-slash": False, "/end.pdf": False, "/end.pdf?x": True}
    cut = checked(spark, ["/x"], body="#" * rb.SIZE_CAP + "\nUser-agent: *\nDisallow: /")
    assert cut["/x"].allowed


@pytest.mark.parametrize("status, allowed", [(0, False), (200, True), (204, True), (301, True), (401, False), (403, False), (404, True), (410, True), (429, False), (500, False), (503, False)])
def test_robots_status(spark, status, allowed):
    assert spark.range(1).select((rb.policy_mode(F.lit(status)) != "disallow_all").alias("x")).first().x == allowed


def test_one_lookup_per_origin(spark):
    df = spark.createDataFrame([("http://a.example/1",), ("http://a.example:80/2",), ("https://a.example/",), ("http://b.example:8080/",)], "url string")
    assert sorted(r.robots_url for r in rb.origins(df).collect()) == ["http://a.example/robots.txt", "http://b.example:8080/robots.txt", "https://a.example/robots.txt"]


ATTEMPTS = "host string, seq long, attempt int, status int, retry_after double, challenge boolean"


def random_log(seed=3, n=400):
    rng = random.Random(seed)
    return [(f"h{rng.randrange(12)}", i, rng.randrange(3), rng.choice([200, 200, 200, 404, 503, 500, 0, None, 301] + [429] * (i % 7 == 0) + [403] * (i % 90 == 0)), rng.choice([None, 1.0, 500.0]), rng.random() < 0.002) for i in range(n)]


def folded(log):
    state, out = {}, []
    for host, seq, attempt, status, retry, challenge in sorted(log, key=lambda r: (r[0], r[1])):
        state[host], action, reason, wait = crawl.assess(state.get(host, (None, 0, 0)), status or 0, attempt, retry, challenge)
        out.append((host, seq, attempt, status or 0, action, reason, wait))
    return out


def test_guard_equals_a_fold(spark):
    log = random_log()
    got = [tuple(r) for r in crawl.guard(spark.createDataFrame(log, ATTEMPTS)).orderBy("host", "seq").collect()]
    assert got == folded(log) and {r[5] for r in got} >= {"server_errors", "rate_limited", "rate_limited_twice", "stopped_before", "client_error", "ok"}


def test_guard_steps():
    step = lambda state, status, attempt=0, retry=None, challenge=False: crawl.assess(state, status, attempt, retry, challenge)
    new = (None, 0, 0)
    assert [step(new, s)[1] for s in (200, 301, 404, 403, 451, 429, 503, 0)] == ["ok", "ok", "skip_url", "stop_host", "stop_host", "retry", "retry", "retry"]
    assert step(new, 200, challenge=True)[2] == "challenge"
    assert [step(new, 429, 0, r)[3] for r in (None, 0.5, 60.0, 999.0)] == [30.0, 2.0, 60.0, 120.0]
    assert step((None, 1, 0), 429)[2] == "rate_limited_twice" and step((None, 1, 3), 200)[0] == (None, 1, 0)
    assert [step(new, 503, a)[3] for a in (0, 1)] == [10.0, 20.0] and step(new, 503, 2)[1] == "skip_url"
    assert step((None, 0, 4), 500)[2] == "server_errors" and step(("x", 0, 0), 200)[1] == "stop_host"


def test_streamed_guard_equals_the_batch(spark, tmp_path):
    log, folder = random_log(5, 200), f"{tmp_path}/in"
    for k in range(2):
        spark.createDataFrame(log[k * 100 : k * 100 + 100], ATTEMPTS).coalesce(1).write.mode("append").json(folder)
        stream = spark.readStream.schema(ATTEMPTS).json(folder)
        q = streaming.guarded(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, folded(log)))


def test_streamed_counters(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:10' as ts, 'a' as event union all select timestamp'2024-01-01 00:00:50', 'a' union all select timestamp'2024-01-01 01:00:00', 'b'").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event string").json(f"{tmp_path}/in")
    q = streaming.counters(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.event, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", 2)]


def test_spacing_equals_a_clock(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for h in range(6):
        now, delay = 0.0, 2.0 + h
        last = None
        for i in range(30):
            now += rng.choice([0, 0.5, 4, 30])
            pause = rng.choice([0.0, 0.0, 10.0]) if i else 0.0
            rows.append((f"h{h}", i, now, pause, delay))
            last = now if last is None else max(now, last + delay + pause)
            want[f"h{h}", i] = round(last, 6)
    df = spark.createDataFrame(rows, "host string, seq int, arrival double, pause double, delay double")
    assert {(r.host, r.seq): r.start for r in crawl.spaced(df, F.col("delay")).collect()} == want


def simulated_frontier(seeds, links, budget, depth):
    after = {}
    for s, p, u, score in sorted(links):
        after.setdefault(s, []).append((p, u, score))
    seen, heap, out, n = set(), [], [], 0
    for _, u in sorted(seeds):
        if u not in seen:
            seen.add(u)
            heapq.heappush(heap, (-100, 0, n, u))
            n += 1
    while heap and len(out) < budget:
        score, d, _, u = heapq.heappop(heap)
        out.append((len(out), u, d, -score))
        for _, v, s in after.get(u, []) if d < depth else []:
            if v not in seen:
                seen.add(v)
                heapq.heappush(heap, (-s, d + 1, n, v))
                n += 1
    return out


def test_frontier_in_order_equals_a_simulation(spark):
    rng = random.Random(4)
    links = sorted({(f"u{rng.randrange(40)}", k % 5, f"u{rng.randrange(60)}"): rng.randrange(-5, 12) for k in range(300)}.items())
    links = [(s, k * 7 + i, u, score) for i, ((s, k, u), score) in enumerate(links)]
    seeds = [(0, "u1"), (1, "u2"), (2, "u1")]
    df = spark.createDataFrame([("x", *r) for r in links], "university string, source string, position int, url string, score int")
    sd = spark.createDataFrame([("x", *r) for r in seeds], "university string, position int, url string")
    for budget, depth in ((1000, 6), (12, 2)):
        got = [(r.visit, r.url, r.depth, r.score) for r in crawl.frontier_in_order(sd, df, budget, depth).orderBy("visit").collect()]
        assert got == simulated_frontier(seeds, links, budget, depth)


def test_frontiers_of_several_sites_where_positions_repeat(spark):
    """Pages that share a URL have links at the same positions, some to the same target with another score."""
    rng = random.Random(7)
    sites = ["a", "b", "c"]
    seeds = {x: [(1, "u3"), (0, "u2"), (0, "u1")] for x in sites} | {"lone": [(0, "u9")]}
    links = {x: [(f"u{rng.randrange(30)}", rng.randrange(3), f"u{rng.randrange(45)}", rng.randrange(-3, 6)) for _ in range(400)] for x in sites}
    df = spark.createDataFrame([(x, *r) for x in sites for r in links[x]], "university string, source string, position int, url string, score int").repartition(7)
    sd = spark.createDataFrame([(x, *r) for x, rows in seeds.items() for r in rows], "university string, position int, url string")
    for budget, depth in ((1000, 6), (12, 2), (5, 0)):
        got = crawl.frontier_in_order(sd, df, budget, depth).orderBy("visit").collect()
        for x in seeds:
            assert [(r.visit, r.url, r.depth, r.score) for r in got if r.university == x] == simulated_frontier(seeds[x], links.get(x, []), budget, depth)


def test_registered_frontier_equals_a_simulation(spark):
    seeds = [(r.position, r.url) for r in crawling._seeds(spark, SF).collect()]
    links = [(r.source, r.position, r.url, r.score) for r in crawling.page_edges(spark, SF).collect()]
    got = [(r.visit, r.url, r.depth, r.score) for r in catalog.QUERIES["frontier_exact"](spark, SF).orderBy("visit").collect()]
    assert got == simulated_frontier(seeds, links, 100, 6)


SITE = "https://www.mini.example"
PATHS = {
    "/": dict(links=["/people", "/private/x", "/file.pdf", "https://else.example/", "/moved", "/slow", "/print"]),
    "/people": dict(links=["/people/a", "/jobs/phd", "/robots-after", "/people"], nofollow=False),
    "/people/a": dict(links=["/deep"], noindex=True),
    "/jobs/phd": dict(links=["/jobs/2"], nofollow=True),
    "/moved": dict(final="/people/b"),
    "/people/b": dict(links=["/from-moved"]),
    "/robots-after": dict(final="/private/y"),
    "/slow": dict(status=[503, 503, 200]),
    "/print": dict(kind="pdf"),
    "/from-moved": dict(status=[404]),
    "/deep": dict(final="https://else.example/out"),
}


def mini_site(spark, **changes):
    paths = {**PATHS, **changes}
    full = lambda p: p if p.startswith("http") else SITE + p
    fetches = [
        (full(p), a, d.get("status", [200])[min(a, len(d.get("status", [200])) - 1)], None, d.get("challenge", False), full(d["final"]) if "final" in d else None, d.get("kind") != "pdf", d.get("noindex", False), d.get("nofollow", False))
        for p, d in paths.items()
        for a in range(3)
    ]
    links = [(full(p), k, full(u)) for p, d in paths.items() for k, u in enumerate(d.get("links", []))]
    t = {
        "fetches": spark.createDataFrame(fetches, "url string, attempt int, status int, retry_after double, challenge boolean, final_url string, is_html boolean, noindex boolean, nofollow boolean"),
        "links": spark.createDataFrame(links, "source string, position int, url string").withColumn("score", urls.link_score(F.col("url"), F.lit(""), [])),
        "domains": spark.createDataFrame([("u", "mini.example")], "university string, domain string"),
        "robots_files": spark.createDataFrame([(SITE, changes.get("robots", 200) if isinstance(changes.get("robots"), int) else 200, "User-agent: *\nDisallow: /private\nCrawl-delay: 3\n")], "origin string, status int, body string"),
        "seeds": spark.createDataFrame([("u", 0, SITE + "/", "home")], "university string, position int, url string, section string"),
    }
    return t


def visits_of(spark, t, max_pages=50, max_depth=3):
    nodes = replay.prepared(t["seeds"], t["fetches"], t["links"], t["domains"], t["robots_files"], depth=max_depth)
    plans = spark.createDataFrame([("u", max_pages, max_depth)], "university string, max_pages int, max_depth int")
    return plans, replay.replayed(plans, t["seeds"], nodes).orderBy("n")


def test_a_whole_crawl(spark):
    plans, visits = visits_of(spark, mini_site(spark))
    rows = visits.collect()
    events = {r.url.removeprefix(SITE): r.event for r in rows}
    assert events == {
        "/": "page", "/people": "page", "/jobs/phd": "page", "/people/a": "skip.noindex", "/private/x": "robots.disallowed", "/moved": "page", "/slow": "page", "/print": "skip.non_html",
        "/robots-after": "robots.disallowed_after_redirect", "/from-moved": "skip.http_error", "/deep": "skip.redirect_out_of_scope",
    }
    # neither files nor other hosts are pushed, nor what a page says not to follow
    by = {r.url.removeprefix(SITE): r for r in rows}
    assert by["/slow"].requests == 3 and by["/slow"].waited == 30.0 and by["/moved"].final_url == SITE + "/people/b" and by["/from-moved"].via == SITE + "/people/b"
    assert by["/private/x"].requests == 0 and by["/private/x"].reason == "/private" and by["/jobs/phd"].followed is False
    # jobs and people come before the rest
    assert [r.url.removeprefix(SITE) for r in rows][:4] == ["/", "/people", "/jobs/phd", "/people/a"]
    assert replay.nothing_fetched(plans, visits, spark.createDataFrame([], "origin string, mode string")).count() == 0
    counters = {r.event: (r.urls, r.requests) for r in replay.crawl_counters(visits).collect()}
    assert counters["page"] == (5, 7) and counters["robots.disallowed"] == (1, 0)


def test_limits_count_requests(spark):
    _, visits = visits_of(spark, mini_site(spark), max_pages=6)
    assert sum(r.requests for r in visits.collect()) == 6
    _, flat = visits_of(spark, mini_site(spark), max_depth=0)
    assert [r.event for r in flat.collect()] == ["page"]


def test_a_stopped_host(spark):
    _, visits = visits_of(spark, mini_site(spark, **{"/people": dict(challenge=True)}))
    rows = visits.collect()
    assert [r.event for r in rows[:2]] == ["page", "host.stopped"] and {r.event for r in rows[2:]} == {"skip.host_stopped"}
    assert replay.stopped_hosts(visits).first().stopped == {"www.mini.example": "challenge"}


def test_nothing_fetched(spark):
    t = mini_site(spark)
    t["robots_files"] = spark.createDataFrame([(SITE, 503, "")], "origin string, status int, body string")
    plans, visits = visits_of(spark, t)
    policies = t["robots_files"].select("origin", rb.policy_mode(F.col("status")).alias("mode"))
    r = replay.nothing_fetched(plans, visits, policies).first()
    assert (r.university, r.closed, r.stopped) == ("u", [SITE], None)
    t["robots_files"] = spark.createDataFrame([(SITE, 200, "User-agent: *\nCrawl-delay: 121")], "origin string, status int, body string")
    plans, visits = visits_of(spark, t)
    assert [(x.event, x.reason) for x in visits.collect()] == [("skip.host_stopped", "crawl_delay")]
    assert replay.nothing_fetched(plans, visits, policies.limit(0)).first().stopped == {"www.mini.example": "crawl_delay"}


def test_two_urls_that_lead_to_one_page(spark):
    twice = mini_site(spark, **{"/": dict(links=["/m1", "/m2"]), "/m1": dict(final="/target"), "/m2": dict(final="/target"), "/target": dict()})
    _, visits = visits_of(spark, twice)
    assert [(r.url.removeprefix(SITE), r.event) for r in visits.collect()] == [("/", "page"), ("/m1", "page"), ("/m2", "skip.seen_after_redirect")]


# --- configuration -----------------------------------------------------------------------------------------------


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8-sig")
    return str(path)


def test_settings(tmp_path):
    assert config.settings(None) == config.Settings() and config.settings(f"{tmp_path}/none.json").llm.max_calls_per_run == 150
    s = config.settings(write(tmp_path / "s.json", {"llm": {"max_page_chars": 5000}, "crawl": {"prefilter": "strict"}, "output_dir": "o"}))
    assert (s.llm.max_page_chars, s.crawl.prefilter, s.output_dir, s.crawl.max_bytes) == (5000, "strict", "o", 3_000_000)
    bad = [{"llm": {"temperature": 2}}, {"llm": {"requests_per_minute": 0}}, {"crawl": {"prefilter": "x"}}, {"crawl": {"max_bytes": 10}}, [1], {"llm": {"api_key": "k"}}, {"a": [{"My-Token": "t"}]}]
    for value in bad:
        with pytest.raises(config.ConfigError):
            config.settings(write(tmp_path / "bad.json", value))
    assert config.credentials({"tokens": 5, "token": "", "keyword": "x", "access_token": None}) == []


def test_profiles(tmp_path):
    p = config.profile(write(tmp_path / "p.json", {"target_fields": [" Optics ", "optics"], "keywords": ["", "Light"], "min_field_match": 1, "accept_partial_funding": False}))
    assert p.terms() == ["optics", "light"] and p.accept_partial is False and p.target_degree_levels == ["phd"]
    for value in ({}, {"target_fields": ["x"], "target_degree_levels": ["bachelor"]}, {"target_fields": ["x"], "min_field_match": 1.5}):
        with pytest.raises(config.ConfigError):
            config.profile_of(value)


def test_universities(spark, tmp_path):
    one = {"slug": "b", "name": "B", "allowed_domains": ["b.example"], "sections": [{"name": "s", "kind": "jobs", "tags": [], "seeds": ["https://b.example/"]}]}
    write(tmp_path / "1.json", one)
    write(tmp_path / "0.json", one | {"slug": "a1", "min_delay_seconds": 0.5, "max_pages": 4000})
    df = snapshots.universities(spark, str(tmp_path), config.UNIVERSITY)
    assert [(r.slug, r.delay, r.violations) for r in config.violations(df).orderBy("slug").collect()] == [("a1", 2.0, "max_pages"), ("b", 2.0, "slug")]
    assert [r.max_pages for r in config.with_run_options(df, 500).orderBy("slug").collect()] == [500, 300]
    write(tmp_path / "2.json", one)
    with pytest.raises(config.ConfigError):
        snapshots.universities(spark, str(tmp_path), config.UNIVERSITY)


def test_environment_files(tmp_path):
    into = {"KEPT": "old"}
    path = write(tmp_path / ".env", '# c\nexport NEW="v 1"\nKEPT=new\nlower=x\nnothing\nEMPTY=\n')
    assert config.environment_file(path, into) == ["NEW", "EMPTY"] and into == {"KEPT": "old", "NEW": "v 1", "EMPTY": ""}
    assert config.environment_file(f"{tmp_path}/none", into) == [] and lx.SECRET_NAMES
