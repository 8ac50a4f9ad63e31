"""A whole crawl, replayed over snapshot tables: what a sequential crawler would have asked for, in which order, and why not the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import urls
from ..sources.shared import stored
from . import crawl, robots as rb

TRIES = 3
VISITS = "university string, n int, url string, depth int, score int, section string, via string, event string, reason string, final_url string, requests int, waited double, followed boolean"


def scoped(nodes: DataFrame, domains: DataFrame, keys: tuple[str, ...] = ("university",)) -> DataFrame:
    """nodes (keys, url) with in_scope. domains: keys, domain. Hosts meet domains by an equi-join on the host's suffixes."""
    by = [*keys, "url"]
    inside = _within(nodes, domains, keys).select(*by).distinct().withColumn("in_scope", F.lit(True))
    return nodes.join(inside, by, "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))


def _within(nodes: DataFrame, domains: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """nodes (keys, url) in scope, with the columns of domains: a row per domain that a host belongs to."""
    wide = nodes.select(*keys, "url", F.explode(urls.host_suffixes(urls.host_of(F.col("url")))).alias("domain"))
    allowed = domains.withColumn("domain", F.lower("domain")).distinct()
    return wide.join(allowed, [*keys, "domain"])


def prepared(seeds: DataFrame, fetches: DataFrame, links: DataFrame, domains: DataFrame, robots_files: DataFrame, *, depth: int = 6, agent: str = "pagebot") -> DataFrame:
    """university, url, in_scope, allowed, rule, crawl_delay, refused, responses, links: all that a crawl can meet.

    seeds: university, position, url, section; fetches: url, attempt, status, retry_after, challenge, final_url, is_html,
    noindex, nofollow; links: source (a final URL), position, url, score; domains: university, domain; robots_files:
    origin, status, body. Links that no crawl would push (other files, hosts of nobody), and pages that no seed leads to
    through pages in its university's scope, are left out before anything is gathered: no crawl leaves its scope.
    """
    files = links.where(urls.looks_like_html(F.col("url")))
    moved = fetches.where("final_url is not null and final_url <> url").select(F.col("url").alias("source"), F.col("final_url").alias("url"), F.lit(0).alias("score")).distinct()
    targets = files.select("url").unionByName(moved.select("url")).distinct()
    own = stored(_within(targets, domains).select("university", "url").distinct(), "replay-own")
    wanted = own.select("url").distinct()
    files = files.join(wanted, "url", "left_semi").groupBy("source", "url").agg(F.min("position").alias("position"), F.min_by("score", "position").alias("score"))
    # a page's links stand at its final URL: a redirect is a level of its own, the last page's too
    files = stored(files, "replay-links")
    steps = stored(files.select("source", "url", "score").unionByName(moved).join(own, "url").select("university", "source", "url", "score"), "replay-steps")
    reach = crawl.frontier_by_level(seeds.select("university", "url"), steps, 2 * depth + 1, ("university",)).select("university", "url")
    nodes = scoped(reach, domains).withColumn("origin", urls.origin_of(F.col("url")))
    checked = rb.explained(nodes.select("url", "origin").distinct(), robots_files, agent).select("url", "allowed", "rule", "crawl_delay")
    answer = F.struct("attempt", "status", "retry_after", "challenge", "final_url", "is_html", "noindex", "nofollow")
    answers = fetches.groupBy("url").agg(F.sort_array(F.collect_list(answer)).alias("responses"))
    out = files.groupBy(F.col("source").alias("url")).agg(F.sort_array(F.collect_list(F.struct("position", F.col("url").alias("to"), "score"))).alias("links"))
    nodes = nodes.join(checked, "url", "left").join(answers, "url", "left").join(out, "url", "left")
    refused = crawl.gate({"skip.non_html_url": ~urls.looks_like_html(F.col("url")), "skip.out_of_scope": ~F.col("in_scope")})
    return nodes.select("university", "url", "in_scope", F.coalesce("allowed", F.lit(True)).alias("allowed"), "rule", "crawl_delay", refused.alias("refused"), "responses", "links")


def replayed(plans: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per URL taken from the frontier: university, n, url, depth, score, section, via, event, reason, final_url, requests, waited, followed.

    plans: university, max_pages, max_depth; nodes as prepared() gives them. event is 'page' for what goes on to extraction,
    else the name of the reason (see crawl.before_fetch and crawl.after_fetch). A URL without a response counts as status
    404, one with fewer responses than tries repeats its last. max_pages counts requests, retries and errors included.
    A page that another URL has already been redirected to is not given twice. One university is one task: its order is
    sequential, its pages are those of its own site.
    """
    seeds_ = seeds.groupBy("university").agg(F.sort_array(F.collect_list(F.struct("position", "url", "section"))).alias("seeds"))
    heads = plans.select("university", "max_pages", "max_depth").join(seeds_, "university", "left")

    def run(key: tuple, own: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        rows = list(_visits(own, plan.iloc[0])) if len(plan) else []
        return pd.DataFrame([(key[0], n, *r) for n, r in enumerate(rows)], columns=[x.split()[0] for x in VISITS.split(", ")])

    return nodes.groupBy("university").cogroup(heads.groupBy("university")).applyInPandas(run, VISITS)


def _visits(own: pd.DataFrame, plan: pd.Series):
    known = {r.url: r for r in own.itertuples()}
    frontier, hosts, used = crawl.Frontier(), {}, 0
    for s in plan["seeds"] if plan["seeds"] is not None else []:
        frontier.push(s["url"], 100, 0, s["section"], "")

    def stopped(host: str) -> str | None:
        return hosts.get(host, (None, 0, 0))[0]

    while frontier.heap and used < plan["max_pages"]:
        url, score, depth, section, via = frontier.pop()
        node, host = known.get(url), _host(url)
        skip = lambda event, reason=None, final=None, requests=0, waited=0.0: (url, depth, score, section, via, event, reason, final, requests, waited, False)  # noqa: B023, E731
        if node is None or node.refused:
            yield skip(node.refused if node is not None else "skip.out_of_scope")
        elif stopped(host):
            yield skip("skip.host_stopped", stopped(host))
        elif not node.allowed:
            yield skip("robots.disallowed", node.rule)
        elif node.crawl_delay is not None and node.crawl_delay > crawl.LONGEST_WAIT:
            hosts[host] = ("crawl_delay", 0, 0)
            yield skip("skip.host_stopped", "crawl_delay")
        else:
            action, reason, requests, waited, answer = "ok", "ok", 0, 0.0, None
            answers = list(node.responses) if node.responses is not None else []
            for attempt in range(TRIES):
                answer = answers[min(attempt, len(answers) - 1)] if answers else {"status": 404, "retry_after": None, "challenge": False}
                used, requests = used + 1, requests + 1
                state, action, reason, wait = crawl.assess(hosts.get(host, (None, 0, 0)), answer["status"] or 0, attempt, answer["retry_after"], bool(answer["challenge"]))
                hosts[host] = state
                if action != "retry" or used >= plan["max_pages"]:
                    break
                waited += wait or 0.0
            if action == "stop_host":
                yield skip("host.stopped", reason, None, requests, waited)
                continue
            if action != "ok":
                yield skip("skip.http_error", reason, None, requests, waited)
                continue
            final = answer["final_url"] or url
            there = known.get(final)
            if final != url:
                if there is None or not there.in_scope:
                    yield skip("skip.redirect_out_of_scope", None, final, requests, waited)
                    continue
                if not there.allowed:
                    yield skip("robots.disallowed_after_redirect", there.rule, final, requests, waited)
                    continue
                if final in frontier.seen:
                    yield skip("skip.seen_after_redirect", None, final, requests, waited)
                    continue
                frontier.seen.add(final)
            if not answer["is_html"]:
                yield skip("skip.non_html", None, final, requests, waited)
                continue
            follow = not answer["nofollow"] and depth < plan["max_depth"]
            for link in there.links if follow and there is not None and there.links is not None else []:
                target = known.get(link["to"])
                if target is not None and not target.refused:
                    frontier.push(link["to"], link["score"], depth + 1, section, final)
            event = "skip.noindex" if answer["noindex"] else "page"
            yield (url, depth, score, section, via, event, None if event != "page" else "ok", final, requests, waited, follow)


def _host(url: str) -> str:
    return url.split("/")[2].rsplit("@", 1)[-1].split(":")[0].lower()


def stopped_hosts(visits: DataFrame) -> DataFrame:
    """university, stopped: map of each host that was stopped to the reason."""
    host = urls.host_of(F.col("url"))
    stops = visits.where("event = 'host.stopped' or (event = 'skip.host_stopped' and reason = 'crawl_delay')").groupBy("university", host.alias("host")).agg(F.min_by("reason", "n").alias("reason"))
    return stops.groupBy("university").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("host", "reason")))).alias("stopped"))


def nothing_fetched(plans: DataFrame, visits: DataFrame, policies: DataFrame) -> DataFrame:
    """university, closed (origins that robots rules close altogether), stopped (map): of universities without a single request."""
    idle = plans.select("university").join(visits.where("requests > 0").select("university").distinct(), "university", "left_anti")
    tried = visits.select("university", urls.origin_of(F.col("url")).alias("origin")).distinct()
    closed = tried.join(policies.where("mode = 'disallow_all'").select("origin"), "origin").groupBy("university").agg(F.sort_array(F.collect_set("origin")).alias("closed"))
    nothing = F.array().cast("array<string>")
    out = idle.join(closed, "university", "left").join(stopped_hosts(visits), "university", "left")
    return out.select("university", F.coalesce("closed", nothing).alias("closed"), "stopped")


def crawl_counters(visits: DataFrame) -> DataFrame:
    """university, event, urls, requests, waited."""
    return visits.groupBy("university", "event").agg(F.count("*").alias("urls"), F.sum(F.col("requests").cast("bigint")).alias("requests"), F.sum("waited").alias("waited"))
