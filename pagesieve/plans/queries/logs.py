"""Run statistics and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import stats
from ...sources import sinks
from ...sources.snapshots import table
from .base import frame, query, values


@query("select event_type, count(*) as n, sum(case when value > 50 then 1 else 0 end)::bigint as slow from events group by event_type")
def run_counters(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("bigint")).alias("slow"))


@query("""with e as (select event_type, list(value order by value) as v, count(*) as n from events where value is not null group by event_type)
 select event_type, n as count, round(list_sum(v), 1) as total, round(list_sum(v) / n, 1) as avg, round(v[round_even(0.95 * (n - 1), 0)::bigint + 1], 1) as p95, round(v[n], 1) as max from e""")
def timing_summary(spark, d):
    return stats.timing_summary(table(spark, d, "events"), "event_type", "value")


@query("select count(*) as events, count(distinct user_id) as users, sum(case when event_type = 'error' then 1 else 0 end)::bigint as errors from events")
def grand_totals(spark, d):
    errors = F.sum((F.col("event_type") == "error").cast("bigint"))
    return table(spark, d, "events").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), errors.alias("errors"))


_SPANS = [("r", "1", None, "run"), ("r", "2", "1", "crawl"), ("r", "3", "2", "fetch"), ("r", "4", "1", "write"), ("q", "1", None, "run")]


@query(f"""with recursive s as (select * from {values(_SPANS, 'run_id, span_id, parent_span_id, name')} union all
  select user_id::varchar, event_id::varchar, case when event_id % 10 = 0 then null else (event_id - 1)::varchar end, event_type from (select event_id, 0 as user_id, event_type from events)), tree as (
 select run_id, span_id, 0 as depth, name as path from s where parent_span_id is null union all
 select s.run_id, s.span_id, tree.depth + 1, tree.path || '/' || s.name from s join tree on s.parent_span_id = tree.span_id and s.run_id = tree.run_id) select * from tree""")
def span_tree(spark, d):
    """Own spans, and the events of the log as chains of ten."""
    own = frame(spark, _SPANS, "run_id string, span_id string, parent_span_id string, name string")
    k = F.col("event_id")
    chains = table(spark, d, "events").select(F.lit("0"), k.cast("string"), F.when(k % 10 != 0, (k - 1).cast("string")), "event_type")
    own.unionAll(chains).createOrReplaceTempView("pagesieve_spans")
    return stats.span_tree(spark, "pagesieve_spans")


@query("select event_id, coalesce(props, '') as detail from events where event_type in ('error', 'signup')")
def log_warnings(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("error", "signup")).select("event_id", F.coalesce("props", F.lit("")).alias("detail"))


@query("select event_id, event_type from events where user_id = 7")
def log_url(spark, d):
    return table(spark, d, "events").where("user_id = 7").select("event_id", "event_type")


@query("select event_id, value from events order by value desc, event_id limit 10")
def log_slowest(spark, d):
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "value")


@query("select (props::json->>'k')::bigint as rule, count(*) as n from events group by 1")
def log_rule_counts(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("rule")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("select event_id, user_id, value >= 50 as keep from events where event_type = 'purchase'")
def log_decisions(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", (F.col("value") >= 50).alias("keep"))


@query("select event_type as reason, count(*) as n from events group by 1 order by n desc, 1 limit 8")
def log_summary(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(8)


@query("""select event_id, json_extract_string(line, '$.event') as event, json_extract_string(line, '$.level') as level, json_extract_string(line, '$.user_id')::bigint as user_id, json_extract_string(line, '$.secret') as secret, json_extract_string(line, '$.run_id') is null as no_run
 from (select event_id, '{"event": "' || event_type || '", "level": "INFO", "user_id": ' || user_id || ', "secret": "Bearer <redacted>", "run_id": null}' as line from events)""")
def log_lines(spark, d):
    """Events as JSON lines of a run log, keys redacted, read again."""
    digest = F.md5(F.col("event_id").cast("string"))
    fields = F.struct("event_id", "user_id", F.concat(F.lit("Bearer "), digest).alias("secret"), F.lit("clash").alias("event"))
    rows = table(spark, d, "events").select(F.col("event_type").alias("event"), F.lit("INFO").alias("level"), fields.alias("fields"))
    at = lambda name: F.get_json_object("line", f"$.{name}")
    return sinks.event_lines(rows).select(at("event_id").cast("bigint").alias("event_id"), at("event").alias("event"), at("level").alias("level"), at("user_id").cast("bigint").alias("user_id"), at("secret").alias("secret"), at("run_id").isNull().alias("no_run"))


_RESULTS = "select 'u' || (user_id % 5) as slug, count(*) as pages, sum(case when event_type = 'purchase' then 1 else 0 end)::bigint as llm, sum(case when event_type = 'click' then 1 else 0 end)::bigint as kept, sum(case when event_type = 'view' then 1 else 0 end)::bigint as dropped from events group by 1"


@query(f"select slug as university, pages, llm, kept, dropped, case when slug = 'u1' then 'h: refused' else '' end as stopped from ({_RESULTS})")
def result_table(spark, d):
    """The report at the end of a run."""
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("bigint"))
    slug = F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))
    r = table(spark, d, "events").groupBy(slug.alias("slug")).agg(F.count("*").alias("pages_fetched"), n("purchase").alias("llm_calls"), n("click").alias("kept"), n("view").alias("rejected"))
    none = F.create_map().cast("map<string,string>")
    return sinks.result_table(r.withColumn("blocked_hosts", F.when(F.col("slug") == "u1", F.create_map(F.lit("h"), F.lit("refused"))).otherwise(none)))
