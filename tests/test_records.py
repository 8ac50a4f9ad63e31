"""Decisions, records, sinks and logs on own cases, and a run from pages to files."""

import csv
import io
import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from pagesieve.operators import classify as cl, decisions as dc, entities as en, replies as rp
from pagesieve.plans import catalog, pipeline as pl
from pagesieve.plans.queries.deciding import PROFILE, SITE, TERMS
from pagesieve.sources import sinks, snapshots


def test_first_json_objects(spark):
    cases = {'```json\n{"a": 1}\n```': {"a": 1}, 'x {y} {"b": {"c": "}"}} {"d": 1}': {"b": {"c": "}"}}, "[1]": None, '{"a": ': None, "": None, '{"ä": "\\u00e4"}': {"ä": "ä"}}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", dc.first_json_object(F.col("t")).alias("o"))
    assert {r.t: r.o and json.loads(r.o) for r in df.collect()} == cases


def test_valid_decisions(spark):
    cases = {"{}": True, '{"people": [{"name": "A"}]}': True, '{"people": [{"email": "x"}]}': False, "[]": False, "no": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", dc.valid(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases


def test_profile_terms():
    assert dc.Profile([" Optics", "optics", ""], ["Light "]).terms() == ["optics", "light"]


def naive_merge(rows):
    """The sequential merge, record by record."""
    key = lambda name: " ".join(w for w in name.lower().replace("dr.", " ").split())
    merged = {}
    for r in rows:
        k = r["email"].lower() if r["email"] else f"name:{key(r['name'])}"
        if k.startswith("name:"):
            k = next((e for e, old in merged.items() if key(old["name"]) == k[5:]), k)
        if k not in merged:
            merged[k] = {**r}
            continue
        old = merged[k]
        for c in ("title_role", "email"):
            old[c] = old[c] or r[c]
        rank = {"full": 3, "partial": 2, "unclear": 1, "none": 0, "": -1}
        if rank[r["funding_status"]] > rank[old["funding_status"]]:
            old["funding_status"] = r["funding_status"]
        old["field_match_score"] = max(old["field_match_score"], r["field_match_score"])
        for c in ("degree_levels", "github"):
            old[c] = [*old[c], *(x for i, x in enumerate(r[c]) if x and x not in old[c] and x not in r[c][:i])]
        if r["rationale"] and r["rationale"] not in old["rationale"]:
            old["rationale"] = f"{old['rationale']} / {r['rationale']}" if old["rationale"] else r["rationale"]
    return [{**v, "university": "u"} for v in merged.values()]


def test_merge_equals_a_fold(spark):
    rng = random.Random(7)
    rows = [
        {
            "seq": i,
            "name": rng.choice(["Dr. A B", "C D", "E", "F G"]),
            "title_role": rng.choice(["", f"t{i}"]),
            "email": rng.choice(["", "", "x@a.b", "X@A.b", "y@a.b"]),
            "funding_status": rng.choice(["", "none", "unclear", "partial", "full"]),
            "field_match_score": rng.choice([0.1, 0.5, 0.9]),
            "degree_levels": rng.choice([[], ["phd"], ["phd", "phd", ""], ["master", "phd"]]),
            "github": [f"g{rng.randrange(4)}"],
            "rationale": rng.choice(["", "long reason", "reason", "other"]),
            "llm_model": f"m{i}",
        }
        for i in range(60)
    ]
    names = list(rows[0])
    for part in (rows[:12], rows):
        schema = "university string, seq long, name string, title_role string, email string, funding_status string, field_match_score double, degree_levels array<string>, github array<string>, rationale string, llm_model string"
        df = spark.createDataFrame([("u", *(r[c] for c in names)) for r in part], schema)
        got = {r.seq: r.asDict() for r in en.merged(df).collect()}
        want = {r["seq"]: r for r in naive_merge(part)}
        assert got == want


def test_cells(spark):
    df = spark.createDataFrame([("u", "=1+1", ["a", "", None, "b"], 0.125, None), ("v", "-5.25", [], 0.135, 1.0)], "university string, name string, github array<string>, field_match_score double, funding_confidence double")
    a, b = sinks.cells(df).collect()
    assert (a.name, a.github, a.field_match_score, a.funding_confidence, a.run_id) == ("'=1+1", "a | b", "0.12", "", "")
    assert (b.name, b.github, b.field_match_score, b.funding_confidence) == ("-5.25", "", f"{0.135:.2f}", "1.00")
    assert len(a) == 32 and sinks.cells(df).columns == sinks.COLUMNS


def test_record_files(spark, tmp_path):
    rows = [("Uni B", "z", 0.5, "x,\"y\"\nz"), ("Uni A", "b", 0.5, ""), ("Uni A", "c", 0.9, ""), ("Uni A", "a", 0.5, "")]
    df = spark.createDataFrame(rows, "university string, name string, field_match_score double, rationale string").withColumn("funding_confidence", F.lit(0.2))
    made = sinks.write_records(df, str(tmp_path), "Quantum Optics!", "20250601T000000Z")
    assert made == {s: f"{tmp_path}/{s}/{s}__quantum-optics__20250601T000000Z.csv" for s in ("uni-a", "uni-b")}
    raw = Path(made["uni-a"]).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfuniversity,name,") and raw == (tmp_path / "uni-a" / "latest.csv").read_bytes()
    table = list(csv.DictReader(io.StringIO(raw.decode("utf-8-sig"))))
    assert [r["name"] for r in table] == ["c", "a", "b"] and list(table[0]) == sinks.COLUMNS and table[0]["field_match_score"] == "0.90"
    other = list(csv.DictReader(io.StringIO(Path(made["uni-b"]).read_text("utf-8-sig"))))
    assert other[0]["rationale"] == 'x,"y"\nz'
    sinks.write_records(df.limit(2), str(tmp_path), "Quantum Optics!", "20250601T000000Z")
    assert not list(tmp_path.glob("_*"))


def rejections_of(folder):
    parts = sorted(folder.glob("part-*"), key=lambda p: "header" not in p.name)
    return list(csv.reader(io.StringIO("".join(p.read_text("utf-8-sig") for p in parts))))


def test_rejection_files(spark, tmp_path):
    _, rejections, _ = pl.evaluate(spark.createDataFrame(SITE, "page_id long, url string, html string"), PROFILE, today="2025-06-01", university="Mini", terms=TERMS)
    folder = tmp_path / "rejected.csv"
    sinks.append_rejections(rejections, str(folder))
    sinks.append_rejections(rejections.withColumn("summary", F.lit("+again")), str(folder))
    rows = rejections_of(folder)
    assert rows[0] == ["university", "url", "page_kind", "stage", "reasons", "summary", "field_match_score", "funding_status"]
    assert len(rows) == 3 and {r[5] for r in rows[1:]} == {"deterministic decision", "'+again"}
    assert rows[1][:5] == ["Mini", "https://mini.example.org/people/bob", "profile", "rules", "degree_level_not_targeted"] and rows[1][6:] == ["0.70", "partial"]
    assert sum(p.read_bytes().count(b"\xef\xbb\xbf") for p in folder.glob("part-*")) == 1


def test_a_run_from_pages_to_records(spark):
    pages = spark.createDataFrame(SITE, "page_id long, url string, html string")
    records, rejections, statistics = pl.evaluate(pages, PROFILE, today="2025-06-01", university="Mini", terms=TERMS, run_id="r1", checked_utc="2025-06-01T00:00:00+00:00")
    r = records.collect()
    assert [(x.name, x.email, x.funding_status, x.llm_provider, x.run_id, sorted(x.source_urls)) for x in r] == [("Ada Byron", "ada@byron.example.org", "full", "mock", "r1", ["https://mini.example.org/jobs/1", "https://mini.example.org/people/ada"])]
    assert set(records.columns) == {*sinks.COLUMNS, "seq"} and r[0].degree_levels == ["phd"] and r[0].rationale == "keyword overlap"
    assert sum(x.pages for x in statistics.collect()) == 3 and rejections.count() == 1
    off = pl.evaluate(pages, PROFILE, today="2025-06-01", mode="off", least=0, terms=TERMS, budget=1)
    assert [x.reasons for x in off[1].orderBy("url").collect()].count(["llm_budget_exhausted"]) == 2
    strict = pl.evaluate(pages, dc.Profile(["nothing here"]), today="2025-06-01", mode="strict", terms=TERMS)
    assert strict[0].count() == 0 and {x.stage for x in strict[1].collect()} == {"prefilter"}


def test_cached_replies_cost_nothing(spark, tmp_path):
    pages = pl.prefiltered(pl.analysed(spark.createDataFrame(SITE, "page_id long, url string, html string"), PROFILE, TERMS))
    pages = pages.select(F.lit("u").alias("university"), F.col("page_id").alias("visit"), F.col("canonical").alias("url"), "kind", "title", "text", "emails", "profile_links", "signals")
    scorer = cl.SentenceScorer(fields=PROFILE.target_fields, **TERMS)
    first = cl.classified(pages, PROFILE, scorer, today="2025-06-01", budget=2)
    sinks.append_cache(cl.new_replies(first), f"{tmp_path}/cache")
    cache = snapshots.cached_replies(spark, f"{tmp_path}/cache")
    again = cl.classified(pages, PROFILE, scorer, today="2025-06-01", cache=cache, budget=0)
    assert sorted((r.visit, r.cached, r.reasons == ["llm_budget_exhausted"]) for r in again.collect()) == [(-3, True, False), (-2, True, False), (-1, False, True)]
    s = cl.call_statistics(first).first()
    assert (s.calls, s.cache_hits, s.skipped, s.output_tokens) == (2, 0, 1, 400)
    # another day asks anew: the day is part of the prompt
    assert cl.classified(pages, PROFILE, scorer, today="2025-06-02", cache=cache, budget=0).where("cached").count() == 0
    assert cl.hallucinations(first).count() == 0


def test_provider_replies(spark):
    bodies = {
        "gemini": {"candidates": [{"content": {"parts": [{"text": "t", "thought": True}, {"text": "{}"}]}, "finishReason": "STOP"}], "usageMetadata": {"promptTokenCount": 3, "candidatesTokenCount": 4}},
        "anthropic": {"model": "m", "content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": "{}"}], "usage": {"input_tokens": 3, "output_tokens": 4}, "stop_reason": "STOP"},
        "chat": {"model": "m", "choices": [{"message": {"content": "{}"}, "finish_reason": "STOP"}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()], "form string, body string")
    for r in df.select(rp.parsed(F.col("form"), F.col("body")).alias("r")).collect():
        assert (r.r.text, r.r.input_tokens, r.r.output_tokens, r.r.finish_reason, r.r.error) == ("{}", 3, 4, "STOP", None)


def test_summaries_and_logs(spark, tmp_path):
    results = spark.createDataFrame([("b", 3, 1, 2, 0, {"h": "refused"}), ("a", 5, 0, 1, 4, {})], "slug string, pages_fetched int, llm_calls int, kept int, rejected int, blocked_hosts map<string,string>")
    assert [tuple(r) for r in sinks.result_table(results).collect()] == [("a", 5, 0, 1, 4, ""), ("b", 3, 1, 2, 0, "h: refused")]
    sinks.write_summary(results.drop("blocked_hosts"), f"{tmp_path}/summary")
    r = snapshots.run_summary(spark, f"{tmp_path}/summary").first()
    assert (r.totals.pages_fetched, r.totals.kept, [u.slug for u in r.universities]) == (8, 3, ["a", "b"])
    key = "Bearer " + "k" * 20
    events = spark.sql(f"select '2025-06-01T14:05:12.345Z' as ts, 'INFO' as level, 'fetch.done' as event, 'u' as university, named_struct('url', 'https://a.example/', 'status', 200, 'auth', '{key}', 'none', '', 'level', 'x', 'long', repeat('y', 300)) as fields")
    sinks.write_events(events, f"{tmp_path}/events")
    e = snapshots.log_events(spark, f"{tmp_path}/events").first()
    assert (e.level, e.event, e.run_id) == ("INFO", "fetch.done", None) and key not in str(e.payload)
    line = sinks.event_texts(events).first().line
    assert line.startswith("14:05:12.345 INFO    [u] fetch.done url=https://a.example/ status=200 auth=Bearer <redacted> level=x long=yyy") and line.endswith("y…") and "none" not in line
    calls = spark.createDataFrame([(7, "https://a.example/", "say " + key, "z" * 600)], "n int, url string, prompt string, reply string")
    r = sinks.call_log(calls).first()
    assert r.file == "0007-" + __import__("hashlib").sha1(b"https://a.example/").hexdigest()[:10] + ".json" and len(json.loads(r.line)["reply_preview"]) == 500
    assert "<redacted>" in sinks.call_log(calls, trace=True).first().line
    d = sinks.dump_index(calls.withColumn("status", F.lit(200))).first()
    assert (len(d.file), d.url, d.status) == (21, "https://a.example/", 200)


def test_queries_have_sql():
    assert {*catalog.QUERIES} - {*catalog.ORACLES} == {"frontier_exact", "crawl_replay", "decision_pipeline", "record_cells"}
    assert all(len(sql) > 40 for sql in catalog.ORACLES.values())
