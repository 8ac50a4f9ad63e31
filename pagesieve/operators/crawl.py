"""Crawl rules over snapshots: gate, guard, spacing, budgets, frontier."""

from __future__ import annotations

import heapq
import os
import sqlite3
import tempfile
from collections.abc import Iterator
from contextlib import closing
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import lexicons as lx, urls
from ..sources.shared import stored

SHORTEST_WAIT, LONGEST_WAIT, USUAL_WAIT, FIVE = 2.0, 120.0, 30.0, 5
MINUTE = 60_000_000


def challenged(header: Column, body: Column, status: Column) -> Column:
    """An interstitial: said by the header, or by a marker in the head of the body of a refused or small page."""
    head = F.lower(F.left(body, F.lit(40000)))
    marked = F.exists(F.array(*map(F.lit, lx.CHALLENGE_MARKERS)), lambda m: F.contains(head, m))
    refused_or_small = status.isin(403, 429, 503) | (F.length(body) < 60000)
    return F.coalesce(F.lower(header) == "challenge", F.lit(False)) | F.coalesce(marked & refused_or_small, F.lit(False))


def gate(columns: dict[str, Column]) -> Column:
    """First reason to skip a URL, else NULL. Keys in order of precedence; each value is true when the reason holds."""
    return F.coalesce(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(reason)) for reason, cond in columns.items()))


def before_fetch(url: Column, in_scope: Column, host_stopped: Column, allowed: Column, crawl_delay: Column) -> Column:
    """Why a URL is not requested, else NULL."""
    return gate(
        {
            "skip.non_html_url": ~urls.looks_like_html(url),
            "skip.out_of_scope": ~in_scope,
            "skip.host_stopped": host_stopped,
            "robots.disallowed": ~allowed,
            "skip.crawl_delay": crawl_delay > LONGEST_WAIT,
        }
    )


def after_fetch(action: Column, moved: Column, in_scope: Column, allowed: Column, is_html: Column, noindex: Column) -> Column:
    """Why the page of a request is dropped, else NULL. action: the guard's; in_scope, allowed: of where a redirect led."""
    return gate(
        {
            "host.stopped": action == "stop_host",
            "skip.http_error": action.isin("skip_url", "retry"),
            "skip.redirect_out_of_scope": moved & ~in_scope,
            "robots.disallowed_after_redirect": moved & ~allowed,
            "skip.non_html": ~is_html,
            "skip.noindex": noindex,
        }
    )


def pushable(url: Column, domains: list[str], depth: Column, most: Column, nofollow: Column) -> Column:
    """Whether a link found at this depth enters the frontier."""
    inside = urls.in_scope(urls.host_of(url), domains)
    return F.coalesce(inside & urls.looks_like_html(url) & (depth < most) & ~nofollow, F.lit(False))


def guard(attempts: DataFrame) -> DataFrame:
    """host, seq, status, attempt, action, reason, wait for each attempt, in the order of seq within its host.

    attempts: host, seq, attempt (from 0), status (null: network error), retry_after (seconds or null), challenge. Once
    stopped, a host stays stopped. Counts up to the first stop do not depend on it, so running sums over the host's
    ordered log say what a sequential guard would: 429s so far, and server errors since the last calm answer. A host's
    log is bounded by its spacing of 2 s and more; windows stream through it.
    """
    a = attempts.select("host", "seq", "attempt", F.coalesce("status", F.lit(0)).alias("status"), "retry_after", F.coalesce("challenge", F.lit(False)).alias("challenge"))
    status, challenge = F.col("status"), F.col("challenge")
    server, limited, refused = (status == 0) | (status >= 500), status == 429, status.isin(lx.STOP_STATUSES)
    order = W.partitionBy("host").orderBy("seq", "attempt")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    total = lambda cond, window: F.sum(cond.cast("int")).over(window)
    a = a.withColumns({"_limited": total(limited & ~challenge, upto), "_calm": total(~challenge & ~server & ~limited & ~refused, upto)})
    run = W.partitionBy("host", "_calm").orderBy("seq", "attempt").rowsBetween(W.unboundedPreceding, 0)
    a = a.withColumn("_streak", total(server & ~challenge, run))
    reason = (
        F.when(challenge, "challenge")
        .when(refused, "refused")
        .when(limited & (F.col("_limited") >= 2), "rate_limited_twice")
        .when(limited, "rate_limited")
        .when(server & (F.col("_streak") >= FIVE), "server_errors")
        .when(server & (F.col("attempt") < 2), "server_error")
        .when(server, "server_error_last")
        .when(status.between(400, 499), "client_error")
        .otherwise("ok")
    )
    a = a.withColumn("reason", reason)
    stops = F.col("reason").isin("challenge", "refused", "rate_limited_twice", "server_errors")
    a = a.withColumn("_before", F.coalesce(F.max(stops).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    a = a.withColumn("reason", F.when(F.col("_before"), "stopped_before").otherwise(F.col("reason")))
    said = F.col("reason")
    action = (
        F.when(said.isin("stopped_before", "challenge", "refused", "rate_limited_twice", "server_errors"), "stop_host")
        .when(said.isin("rate_limited", "server_error"), "retry")
        .when(said.isin("server_error_last", "client_error"), "skip_url")
        .otherwise("ok")
    )
    asked = F.least(F.lit(LONGEST_WAIT), F.greatest(F.lit(SHORTEST_WAIT), F.coalesce("retry_after", F.lit(USUAL_WAIT))))
    wait = F.when(said == "rate_limited", asked).when(said == "server_error", 10.0 * (F.col("attempt") + 1))
    return a.select("host", "seq", "attempt", "status", action.alias("action"), "reason", wait.cast("double").alias("wait"))


def assess(state: tuple[str | None, int, int], status: int, attempt: int, retry_after: float | None, challenge: bool) -> tuple[tuple[str | None, int, int], str, str, float | None]:
    """One step of the guard for one host: (state, action, reason, wait). state: reason of its stop or None, 429s, server errors in a row."""
    stopped, limited, streak = state
    stop = lambda reason, n=limited, k=streak: ((stopped or reason, n, k), "stop_host", reason, None)
    if stopped:
        return state, "stop_host", "stopped_before", None
    if challenge:
        return stop("challenge")
    if status in lx.STOP_STATUSES:
        return stop("refused")
    if status == 429:
        if limited:
            return stop("rate_limited_twice", limited + 1)
        wait = min(LONGEST_WAIT, max(SHORTEST_WAIT, USUAL_WAIT if retry_after is None else retry_after))
        return (None, 1, streak), "retry", "rate_limited", wait
    if status == 0 or status >= 500:
        if streak + 1 >= FIVE:
            return stop("server_errors", limited, streak + 1)
        if attempt < 2:
            return (None, limited, streak + 1), "retry", "server_error", 10.0 * (attempt + 1)
        return (None, limited, streak + 1), "skip_url", "server_error_last", None
    bad = 400 <= status < 500
    return (None, limited, 0), "skip_url" if bad else "ok", "client_error" if bad else "ok", None


def spaced(requests: DataFrame, delay: Column) -> DataFrame:
    """requests (host, seq, arrival in seconds) with start: at arrival, but at least the host's constant delay after the one before.

    A pause before a request (column pause, in seconds, optional) puts off its earliest start by as much after the one before.
    """
    order = W.partitionBy("host").orderBy("seq")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    pause = F.coalesce("pause", F.lit(0.0)) if "pause" in requests.columns else F.lit(0.0)
    # start(n) = max(arrival(n), start(n-1) + delay + pause(n)): a running maximum, less what has been waited up to there
    waited = F.col("_d") * F.col("_n") + F.col("_p")
    numbered = requests.withColumns({"_n": F.row_number().over(order), "_d": delay, "_p": F.sum(pause).over(upto)})
    latest = F.max(F.col("arrival") - waited).over(upto)
    return numbered.withColumn("start", F.round(waited + latest, 6)).drop("_n", "_d", "_p")


def calls_in_last_minute(calls: DataFrame, by: str) -> DataFrame:
    """calls (micros, by) with in_window: calls of the last 60 s, this one included; a call exactly 60 s old has left.

    Calls meet by minute, each also in the minute after its own, so that a busy key is shared out over many tasks.
    """
    own = F.floor(F.col("micros") / MINUTE)
    dealt = calls.select("*", F.explode(F.array(F.struct(own.alias("m"), F.lit(True).alias("own")), F.struct((own + 1).alias("m"), F.lit(False).alias("own")))).alias("_at"))
    window = W.partitionBy(by, "_at.m").orderBy("micros").rangeBetween(1 - MINUTE, 0)
    return dealt.withColumn("in_window", F.count("*").over(window)).where("_at.own").drop("_at")


def retry_schedule(most: int, retry_after: Column, attempt: Column) -> Column:
    """Seconds before the next try, without jitter; NULL when there is none."""
    return F.when(attempt <= most, F.coalesce(retry_after.cast("double"), F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt))))


def within_budget(visits: DataFrame, by: str, order: str, budget: int) -> DataFrame:
    """visits (cached boolean) with allowed: cached ones are free, others count up to the budget in order (unique within by).

    Only the first of each slice of a key can be among its first: slices are cut down before they meet.
    """
    asked = visits.where("not cached").select(F.col(by).alias("_by"), F.col(order).alias("_o"), F.pmod(F.xxhash64(order), F.lit(256)).alias("_s"))
    sliced = asked.withColumn("_k", F.row_number().over(W.partitionBy("_by", "_s").orderBy("_o"))).where(F.col("_k") <= budget)
    last = sliced.withColumn("_k", F.row_number().over(W.partitionBy("_by").orderBy("_o"))).where(F.col("_k") <= budget).groupBy("_by").agg(F.max("_o").alias("_last"))
    out = visits.join(last, visits[by].eqNullSafe(last["_by"]), "left")
    return out.withColumn("allowed", F.col("cached") | F.coalesce(F.col(order) <= F.col("_last"), F.lit(False))).drop("_by", "_last")


def frontier_by_level(seeds: DataFrame, links: DataFrame, depth: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, url, depth, score: every URL once per key, at the first level that finds it, with its best score there.

    seeds: keys, url; links: source, url, score, and the keys unless they are shared by all. Each level is a join with the links, an anti-join with what was
    seen, and an aggregation; it is written, so that the next one does not run it again.
    """
    by, at = [*keys, "url"], [*(k for k in keys if k in links.columns), "source"]
    level = stored(seeds.select(*by, F.lit(0).alias("depth"), F.lit(100).alias("score")).distinct(), "frontier")
    levels = [level]
    for d in range(1, depth + 1):
        found = level.select(*keys, F.col("url").alias("source")).join(links, at).groupBy(*by).agg(F.max("score").alias("score"))
        for before in levels:
            found = found.join(before.select(*by), by, "left_anti")
        level = stored(found.select(*by, F.lit(d).alias("depth"), "score"), "frontier")
        if level.isEmpty():
            break
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def frontier_in_order(seeds: DataFrame, links: DataFrame, budget: int, depth: int) -> DataFrame:
    """university, visit, url, depth, score: the exact best-first order of a sequential crawl, per university.

    seeds: university, position, url; links: university, source, position, url, score. A university's order is
    sequential by definition, so one task follows it; it gets the links of pages that can be reached, each target once
    per page, and no others. They come to it as a sorted stream and wait on its disk: it holds those of visited pages only.
    Links of a page at the same position go by URL; one that comes twice at its first position has the lower score.
    """
    reach = frontier_by_level(seeds, links, depth, ("university",)).where(F.col("depth") < depth).select("university", F.col("url").alias("source"))
    near = links.join(reach, ["university", "source"], "left_semi").groupBy("university", "source", "url").agg(F.min(F.struct("position", "score")).alias("at"))
    first = seeds.select("university", F.lit(None).cast("string").alias("source"), "position", "url", F.lit(100).alias("score"))
    both = first.unionByName(near.select("university", "source", "at.position", "url", "at.score"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = (f[["university", "source", "url", "score"]].astype(object) for f in frames)
        rows = (r for f in whole for r in f.where(f.notna(), None).itertuples(index=False, name=None))
        for university, own in groupby(rows, lambda r: r[0]):
            visits = ((university, n, *v) for n, v in enumerate(_in_order(own, budget, depth)))
            while part := list(islice(visits, 1000)):
                yield pd.DataFrame(part, columns=["university", "visit", "url", "depth", "score"])

    # seeds have no source and come first
    ordered = both.repartition("university").sortWithinPartitions("university", "source", "position", "url")
    return ordered.mapInPandas(run, "university string, visit int, url string, depth int, score int")


def _in_order(rows: Iterator[tuple], budget: int, depth: int) -> Iterator[tuple]:
    """url, depth, score of the visits of one university; rows: university, source, url, score, in order, seeds (without source) first."""
    frontier = Frontier()

    def links() -> Iterator[tuple]:
        for n, (_, source, url, score) in enumerate(rows):
            if source is None:
                frontier.push(url, 100, 0, "", "")
            else:
                yield source, n, url, score

    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryDirectory(dir=local) as folder, closing(sqlite3.connect(f"{folder}/links")) as held:
        for setting in ("journal_mode = off", "synchronous = off"):
            held.execute(f"pragma {setting}")
        held.execute("create table links (source text, n integer, url text, score integer, primary key (source, n)) without rowid")
        held.executemany("insert into links values (?, ?, ?, ?)", links())
        visited = 0
        while frontier.heap and visited < budget:
            url, score, at, _, _ = frontier.pop()
            visited += 1
            yield url, at, score
            if at < depth:
                for u, s in held.execute("select url, score from links where source = ? order by n", (url,)):
                    frontier.push(u, s, at + 1, "", url)


class Frontier:
    """URLs to visit: best score first, then least depth, then first come. A URL enters once ever."""

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.heap: list[tuple] = []

    def push(self, url: str, score: int, depth: int, section: str, via: str) -> None:
        if url not in self.seen:
            self.seen.add(url)
            heapq.heappush(self.heap, (-score, depth, len(self.seen), url, section, via))

    def pop(self) -> tuple[str, int, int, str, str]:
        score, depth, _, url, section, via = heapq.heappop(self.heap)
        return url, -score, depth, section, via


def minute_schedule(calls: DataFrame, by: str, most: int) -> DataFrame:
    """calls (by, seq, arrival) with start: the earliest time at which fewer than most calls started in the last 60 s (+0.05 s).

    A call waits for the one before it and for the one `most` before it, so a key's calls are followed in order, in Arrow
    batches of a sorted stream; state is the last `most` starts.
    """
    kinds = dict(calls.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in calls.columns) + ", start double"

    def follow(batches):
        key, starts = None, []
        for rows in batches:
            out = []
            for k, a in zip(rows[by], rows["arrival"], strict=True):
                if k != key:
                    key, starts = k, []
                t = max(float(a), starts[-1] if starts else float(a))
                if len(starts) >= most and starts[-most] > t - 60:
                    t = starts[-most] + 60.05
                starts = [*starts[1 - most :], t] if most > 1 else [t]
                out.append(t)
            yield rows.assign(start=out)

    return calls.repartition(by).sortWithinPartitions(by, "seq").mapInPandas(follow, schema)
