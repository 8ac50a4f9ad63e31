"""Steps that used to break or differ as their tables grow."""

import gc
import tracemalloc
import weakref

import pandas as pd
import pyarrow as pa
import pytest

from pagesieve.functions import text
from pagesieve.operators import crawl, html, quotes, replay, stats
from pagesieve.plans import catalog


def test_spans_of_any_number_and_depth(spark):
    spans = [("r", str(i), str(i - 1) if i else None, f"s{i}") for i in range(12)] + [("r", "x", "nowhere", "lost"), ("q", "1", "0", "other run")]
    spark.createDataFrame(spans, "run_id string, span_id string, parent_span_id string, name string").createOrReplaceTempView("spans_deep")
    limits = ["spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"]
    try:
        for k in limits:
            spark.conf.set(k, "5")
        got = {r.span_id: (r.depth, r.path) for r in stats.span_tree(spark, "spans_deep").collect()}
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert got == {str(i): (i, "/".join(f"s{j}" for j in range(i + 1))) for i in range(12)}


def test_only_whole_character_names_are_read(spark):
    """A page whose title was cut within a reference: '&amp</h1>' is no '&'."""
    page = '<html lang="en"><title>a&amp;b&amp</title><body><h1>a&amp;&am</h1><p>x &ampx; &#38; &copy; &copy2 &amp;amp</p><a href="/q?a=1&copy=2&amp;b=3">l</a></body>'
    r = html.parsed(spark.createDataFrame([(1, "https://a.example/", page)], "page_id long, url string, html string")).first()
    assert (r.title, r.headings, r.text) == ("a&b&amp", ["a&&am"], "a&&am\nx &ampx; & © &copy2 &amp\nl")
    assert r.links[0].href == "/q?a=1&copy=2&b=3"


def test_an_answer_per_fetch_where_urls_repeat(spark, tmp_path):
    rows = [(i, "https://a.example/x", f"<p>{i}") for i in (1, 2, 3)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["fetch_answers"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.retry_after) for r in got) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_a_worker_holds_few_pages_at_once(spark, monkeypatch):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    pages = [f"<title>{i}</title><p>{'word ' * 20_000}" if i != 3 else None for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(40)), "url": ["https://a.example/"] * 40, "html": pages})
    out = list(html.parsed(df)(iter([batch])))
    assert len(out) >= 4 and max(b.num_rows for b in out) <= 12
    assert [r["page_id"] for b in out for r in b.to_pylist()] == list(range(40))
    assert [r["title"] for b in out for r in b.to_pylist()] == [str(i) if i != 3 else "" for i in range(40)]


def test_a_crawl_gets_no_pages_beyond_its_scope(spark):
    seeds = spark.createDataFrame([("a", 0, "https://a.example/", "s"), ("b", 0, "https://b.example/", "s")], "university string, position int, url string, section string")
    domains = spark.createDataFrame([("a", "a.example"), ("b", "b.example")], "university string, domain string")
    links = [("https://a.example/", 0, "https://b.example/x", 1), ("https://a.example/", 1, "https://a.example/y", 1), ("https://b.example/x", 0, "https://a.example/z", 1)]
    answer = "url string, attempt int, status int, retry_after double, challenge boolean, final_url string, is_html boolean, noindex boolean, nofollow boolean"
    fetches = spark.createDataFrame([("https://a.example/y", 0, 200, None, False, "https://a.example/moved", True, False, False)], answer)
    robots = spark.createDataFrame([], "origin string, status int, body string")
    nodes = replay.prepared(seeds, fetches, spark.createDataFrame(links, "source string, position int, url string, score int"), domains, robots, depth=1)
    got = sorted((r.university, r.url) for r in nodes.collect())
    assert got == [("a", "https://a.example/"), ("a", "https://a.example/moved"), ("a", "https://a.example/y"), ("b", "https://b.example/")]


def test_a_page_leaves_the_quote_search_once(spark, monkeypatch):
    quotes_ = spark.createDataFrame([(i, q) for i, q in enumerate(["one two three four", "two three four five", "three four five six"])], "quote_id long, quote string")
    page = spark.createDataFrame([(7, "one two three four five six")], "doc_id long, text string")
    kind, frames = type(page), []
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, schema: frames.append(own(self, run, schema)) or frames[-1])
    assert sorted((r.quote_id, r.doc_id) for r in quotes.found(quotes_, page).collect()) == [(0, 7), (1, 7), (2, 7)]
    assert frames[0].count() == 1


def test_a_worker_lets_go_of_composed_texts():
    gc.disable()
    try:
        batch = pd.Series(["\ufb01x", None, "e\u0301"])
        held = weakref.ref(batch)
        assert text.nfkc.func(batch).tolist() == ["fix", None, "\xe9"]
        del batch
        assert held() is None
    finally:
        gc.enable()


@pytest.mark.parametrize("name", ["frontier_exact", "frontier_levels", "decision_pipeline"])
def test_a_query_reads_few_pages_at_once(spark, monkeypatch, tmp_path, name):
    """Its step over pages cuts what a worker holds, and asks the session for small batches."""
    pages = [(i, f"https://a.example/{i}", f"<title>{i}</title><a href='/{i + 1}'>the one</a>") for i in range(8)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    kind, steps = type(spark.range(0)), []
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, schema: steps.append((self.columns, run)) or own(self, run, schema))
    limits = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    for k in limits:
        spark.conf.unset(k)
    catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert [spark.conf.get(k) for k in limits] == ["1000", "16m"]
    (columns, run), *others = steps
    assert not others
    long = {"url": ["https://a.example/"] * 40, "html": [f"<p>{'word ' * 20_000}"] * 40}
    out = list(run(iter([pa.RecordBatch.from_pydict({c: long.get(c, list(range(40))) for c in columns})])))
    assert sum(b.num_rows for b in out) == 40 and max(b.num_rows for b in out) <= 12


def test_a_frontier_holds_no_links_of_pages_that_it_does_not_visit(spark, monkeypatch):
    kind, steps = type(spark.range(0)), []
    own = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, run, schema: steps.append(run) or own(self, run, schema))
    seeds = spark.createDataFrame([("x", 0, "s")], "university string, position int, url string")
    links = spark.createDataFrame([("x", "s", 0, "t", 1)], "university string, source string, position int, url string, score int")
    crawl.frontier_in_order(seeds, links, 3, 2)
    (run,) = steps

    def frames():
        yield pd.DataFrame({"university": "x", "source": [None], "position": 0, "url": ["p000"], "score": 100})
        for k in range(100):
            yield pd.DataFrame({"university": "x", "source": f"p{k:03d}", "position": range(1000), "url": [f"p{k + 1:03d}", *(f"{k}-{i}" * 20 for i in range(999))], "score": [9] + [1] * 999})

    tracemalloc.start()
    try:
        got = pd.concat(run(frames()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.values.tolist() == [["x", 0, "p000", 0, 100], ["x", 1, "p001", 1, 9], ["x", 2, "p002", 2, 9]]
    assert peak < 5_000_000
