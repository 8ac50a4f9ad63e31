"""Robots rules: parsing, choice of group, longest match, fetch-status policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import urls

SIZE_CAP = 500 * 1024


def policy_mode(status: Column) -> Column:
    """What a robots.txt fetch with this status means: parsed, allow_all or disallow_all."""
    return F.when(status.between(200, 299), "parsed").when((status == 0) | status.isin(401, 403, 429) | (status >= 500), "disallow_all").otherwise("allow_all")


def _decoded(pattern: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(pattern, F.lit("+"), F.lit("%2B"))), pattern)


def rule_regex(pattern: Column) -> Column:
    """Prefix match in which * stands for anything and a final $ for the end."""
    plain = _decoded(F.regexp_replace(pattern, r"\$$", ""))
    quoted = lambda p: F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    body = F.array_join(F.transform(F.split(plain, r"\*"), lambda p: F.when(p == "", "").otherwise(quoted(p))), ".*")
    return F.concat(F.lit("(?s)^"), body, F.when(pattern.endswith("$"), "$").otherwise(""))


def parsed_rules(files: DataFrame) -> DataFrame:
    """origin, group_id, agent, seq, allow, pattern, crawl_delay: one row per agent and rule; groups without rules have null patterns.

    files: origin, body. Neighbouring agent lines share a group; sitemap lines do not end an agent run, any other key does; rules
    before an agent, and empty values, are ignored.
    """
    lines = files.select("origin", F.posexplode(F.split(F.left(F.col("body"), F.lit(SIZE_CAP)), r"\r\n|\n|\r")).alias("seq", "line"))
    plain = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = lines.select("origin", "seq", F.lower(F.trim(F.regexp_extract(plain, "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract(plain, "^[^:]*:(.*)$", 1)).alias("value")).where("key <> '' and key <> 'sitemap'")
    order = W.partitionBy("origin").orderBy("seq")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("group_id", F.sum(starts.cast("int")).over(order)).where("group_id > 0")
    agents = lines.where("key = 'user-agent'").select("origin", "group_id", F.trim(F.lower(F.get(F.split("value", "/"), F.lit(0)))).alias("agent")).distinct()
    path = F.when(F.col("value").rlike(r"^[/*]"), F.col("value")).otherwise(F.concat(F.lit("/"), F.col("value")))
    rules = lines.where("key in ('allow', 'disallow') and value <> ''").select("origin", "group_id", "seq", (F.col("key") == "allow").alias("allow"), path.alias("pattern"))
    delay = F.expr("try_cast(value as double)")
    delays = lines.where("key = 'crawl-delay'").select("origin", "group_id", "seq", delay.alias("d")).where("d >= 0").groupBy("origin", "group_id").agg(F.max_by("d", "seq").alias("crawl_delay"))
    return agents.join(rules, ["origin", "group_id"], "left").join(delays, ["origin", "group_id"], "left").select("origin", "group_id", "agent", "seq", "allow", "pattern", "crawl_delay")


def sitemaps(files: DataFrame, most: int = 5) -> DataFrame:
    """origin, sitemaps: the first few sitemap lines of each file (origin, body)."""
    lines = F.split(F.left(F.col("body"), F.lit(SIZE_CAP)), r"\r\n|\n|\r")
    found = F.transform(lines, lambda x: F.trim(F.regexp_extract(F.regexp_replace(x, "#.*$", ""), r"(?i)^\s*sitemap\s*:(.*)$", 1)))
    return files.select("origin", F.slice(F.filter(found, lambda x: x != ""), 1, most).alias("sitemaps"))


def origins(pages: DataFrame) -> DataFrame:
    """origin, robots_url: one lookup for every origin among the pages' URLs, however many pages it has."""
    each = pages.select(urls.origin_of(F.col("url")).alias("origin")).where("origin is not null").distinct()
    return each.select("origin", F.concat("origin", F.lit("/robots.txt")).alias("robots_url"))


def chosen_rules(rules: DataFrame, agent: str) -> DataFrame:
    """Rules of all groups that name the agent, else of all * groups; crawl_delay is the largest of the chosen groups."""
    by = W.partitionBy("origin")
    mine = rules.where(F.col("agent").isin(agent.lower(), "*")).withColumn("named", F.max(F.col("agent") == agent.lower()).over(by)).where(F.col("named") == (F.col("agent") == agent.lower()))
    return mine.select("origin", "agent", "seq", "allow", "pattern", F.max("crawl_delay").over(by).alias("crawl_delay")).distinct()


def checked(pages: DataFrame, rules: DataFrame, policies: DataFrame) -> DataFrame:
    """pages (url, origin) with allowed, rule, reason. rules as chosen_rules gives them; policies: origin, mode.

    The longest pattern in UTF-8 bytes that matches path and query wins, allow before disallow; no match allows. The
    origin is an equi-join key, so only rules of a page's own origin are tried.
    """
    target = _decoded(urls.path_and_query(F.col("url")))
    r = rules.where("pattern is not null").select("origin", "seq", "allow", "pattern", rule_regex(F.col("pattern")).alias("regex"))
    hits = pages.select("url", "origin", target.alias("target")).distinct().join(r, "origin").where(F.regexp_like("target", F.col("regex")))
    best = hits.groupBy("url").agg(F.max_by(F.struct("allow", "pattern"), F.struct(F.octet_length("pattern"), "allow", -F.col("seq"))).alias("best"))
    out = pages.join(policies, "origin", "left").join(best, "url", "left")
    itself = urls.path_of(F.col("url")) == "/robots.txt"
    mode = F.coalesce("mode", F.lit("allow_all"))
    reason = F.when(itself, "robots_file").when(mode != "parsed", mode).when(F.col("best").isNull(), "no_matching_rule").otherwise("matched_rule")
    allowed = F.when(itself, True).when(mode == "disallow_all", False).when(mode == "allow_all", True).otherwise(F.coalesce("best.allow", F.lit(True)))
    return out.select(*pages.columns, allowed.alias("allowed"), F.when(reason == "matched_rule", F.col("best.pattern")).alias("rule"), reason.alias("reason"))


def explained(pages: DataFrame, files: DataFrame, agent: str, delay: float = 0.0) -> DataFrame:
    """checked() with grp (whose rules applied), crawl_delay, effective_delay and sitemaps, from robots files (origin, status, body)."""
    policies = files.select("origin", policy_mode(F.col("status")).alias("mode"))
    read = files.where(policy_mode(F.col("status")) == "parsed")
    rules = chosen_rules(parsed_rules(read), agent)
    about = rules.groupBy("origin").agg(F.max("crawl_delay").alias("crawl_delay"), F.max("agent").alias("grp"))
    out = checked(pages, rules, policies).join(about, "origin", "left").join(sitemaps(read), "origin", "left")
    return out.withColumns({"grp": F.coalesce("grp", F.lit("none")), "effective_delay": effective_delay(F.lit(delay), F.col("crawl_delay"))})


def effective_delay(configured: Column, crawl_delay: Column, floor: float = 2.0) -> Column:
    """Seconds between requests to a host: never below the floor."""
    return F.greatest(F.lit(floor), F.coalesce(configured.cast("double"), F.lit(0.0)), F.coalesce(crawl_delay.cast("double"), F.lit(0.0)))
