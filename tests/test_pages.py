"""Pages, texts and addresses on own cases."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagesieve.functions import lexicons as lx, text as tx, urls
from pagesieve.operators import html, quotes
from pagesieve.sources import snapshots

LONG = "words of the page itself, " * 12


def parse(spark, *bodies, url="https://www.uni.example.org/dir/page"):
    return html.parsed(spark.createDataFrame([(i, url, b) for i, b in enumerate(bodies)], "page_id long, url string, html string"))


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(expression.alias("x")).first().x


def test_strings_are_joined_by_blanks(spark):
    r = parse(spark, "<title> a  b\n</title><body><h1>foo<span>bar</span></h1><p>one<b>two</b>three<br>four<!-- c -->five</p></body>").first()
    assert (r.title, r.headings, r.text) == ("a  b", ["foo bar"], "foo bar\none two three\nfour five")


def test_main_comes_before_role_and_article(spark):
    article, role, main = (f"<{t}>{n} {LONG}</{t.split()[0]}>" for t, n in (("article", "A"), ("div role=main", "R"), ("main", "M")))
    got = [r.text[0] for r in parse(spark, f"<body>{article}{role}{main}</body>", f"<body>{article}{role}</body>", f"<body>x{article}</body>", "<body>x<main>short</main></body>").orderBy("page_id").collect()]
    assert got == ["M", "R", "A", "x"]


def test_what_is_left_out_of_the_text(spark):
    page = "<body><nav>nav</nav><header>top</header><script>var a = '</p>';</script><style>p{}</style><form>f<button>b</button></form><aside>side</aside><p>kept &amp;amp; &lt;b&gt;</p><p>kept &amp;amp; &lt;b&gt;</p><footer>foot</footer><noscript>no</noscript></body>"
    inside = f"<body><main><nav>menu</nav>{LONG}</main><p>outside</p></body>"
    r = parse(spark, page, inside).orderBy("page_id").collect()
    assert r[0].text == "kept & <b>" and r[1].text == f"menu {LONG.strip()}"
    # addresses are looked for everywhere but in scripts
    assert "nav" in r[0].raw_text and "foot" in r[0].raw_text and "var" not in r[0].raw_text


def test_ten_headings_with_empty_ones(spark):
    r = parse(spark, "".join(f"<h2>{'' if i % 2 else i}</h2>" for i in range(14))).first()
    assert r.headings == ["0", "", "2", "", "4", "", "6", "", "8", ""]


def test_links(spark):
    page = """<base href="/b/"><a href="x" rel="nofollow">no</a><a href=" y ">Y <i>z</i></a><a href="/b/y#part">again</a><a href="mailto:a@b.org">m</a><a href="#top">t</a>
      <a href="https://github.com/ada" rel="nofollow">g</a><a href="javascript:x()">j</a><a href="https://other.example/people/1">p</a><a href="/Staff/2">s</a><a href="http://[bad/">bad</a>"""
    p = parse(spark, page)
    found = p.select(html.targets(F.col("links")).alias("f"))
    r = found.select(html.followable(F.col("f")).alias("follow"), html.profile_links(F.col("f")).alias("profiles"), html.n_people(html.followable(F.col("f"))).alias("n")).first()
    host = "https://www.uni.example.org"
    assert r.follow == [f"{host}/b/y", "https://other.example/people/1", f"{host}/Staff/2"] and r.n == 2
    assert r.profiles == {"github": ["https://github.com/ada"]}
    rows = sorted((x.url, x.anchor) for x in html.page_links(p).collect())
    assert rows[2] == (f"{host}/b/y", "Y z")


def test_addresses_in_order(spark):
    code = bytes([7, *(b ^ 7 for b in b"hidden@c.org")]).hex()
    page = f"""<body>plain@d.org, img@x.png. <span data-cfemail="{code}">x</span><a href="/cdn-cgi/l/email-protection#{code}">y</a><a href="MAILTO:first%40b.org,second@b.org?subject=a@z.org">z</a>
      "quoted@e.org" jane [at] uni-x [dot] de; PLAIN@d.org</body>"""
    p = parse(spark, page)
    assert p.select(html.emails(p).alias("e")).first().e == ["first@b.org", "second@b.org", "hidden@c.org", "plain@d.org", "quoted@e.org", "jane@uni-x.de"]


def test_directives_and_language(spark):
    r = parse(spark, '<html lang="de"><meta name="ROBOTS" content="NoIndex, follow"><meta name=pagebot content=none><meta name=other content=nofollow>').first()
    assert r.lang == "de" and r.meta_robots == ["follow", "noindex", "none"]
    assert one(spark, html.accept_language(F.array(*map(F.lit, ["de", "fr", "it", "es", "pt", "nl"])))) == "de,fr;q=0.8,it;q=0.6,es;q=0.4,pt;q=0.2,nl;q=0.1,en;q=0.5"
    assert one(spark, html.accept_language(F.array(F.lit("en")))) == "en"


def test_decoding(spark):
    rows = [("ä".encode("latin-1"), "text/html; charset=iso-8859-1"), ('<meta charset="latin-1">ä'.encode("latin-1"), ""), ("ä".encode(), None), ("ä".encode("cp1252"), "x; charset=nonsense"), (b"\x81\xff", ""), (None, "")]
    out = [r.t for r in spark.createDataFrame([(bytearray(b) if b is not None else None, k) for b, k in rows], "b binary, k string").select(html.decoded(F.col("b"), F.col("k")).alias("t")).collect()]
    assert out == ["ä", '<meta charset="latin-1">ä', "ä", "ä", "��", None]


def test_kinds(spark):
    cases = [
        ("https://a.example/jobs/1", "t", [], True, 0, 0, False, "position"),
        ("https://a.example/jobs/1", "t", [], False, 7, 0, False, "listing"),
        ("https://a.example/x", "t", [], True, 0, 13, False, "listing"),
        ("https://a.example/people/x", "t", [], True, 3, 0, False, "profile"),
        ("https://a.example/~doe/", "t", [], False, 4, 0, False, "other"),
        ("https://a.example/x", "Prof. Ada", [], False, 0, 0, False, "profile"),
        ("https://a.example/x", "Drama", [], False, 0, 0, False, "other"),
        ("https://a.example/x", "t", ["a", "b", "PhD", "d"], True, 4, 0, False, "position"),
        ("https://a.example/x", "t", ["a", "b", "c", "PhD"], True, 4, 0, True, "other"),
        ("https://a.example/x", "t", [], False, 2, 0, True, "profile"),
    ]
    df = spark.createDataFrame([c[:-1] for c in cases], "u string, t string, h array<string>, p boolean, e int, n int, l boolean")
    got = df.select(html.page_kind(*(F.col(c) for c in "uthpenl")).alias("k")).collect()
    assert [r.k for r in got] == [c[-1] for c in cases]


def test_match_form_composes(spark):
    raw = "ﬁne　Ｆull‐width ’q’ “x” … ①"
    got = spark.createDataFrame([(raw,), (None,)], "t string").select(tx.match_form(F.col("t"), True).alias("x")).collect()
    want = unicodedata.normalize("NFKC", raw).lower().replace("’", "'").replace("“", '"').replace("”", '"').replace("‐", "-")
    assert got[0].x == " ".join(want.split()) and got[1].x is None


def test_sentences_sections_and_cuts(spark):
    text = "Short phd. A longer sentence about nothing! We offer a phd position here.  Next\nphd " + "x" * 400
    assert one(spark, tx.first_sentence_with(F.col("t"), ["phd"]), t=text) == "We offer a phd position here."
    assert one(spark, tx.first_sentence_with(F.col("t"), ["xxx"]), t=text) == ("phd " + "x" * 400)[:300]
    assert one(spark, tx.section(F.col("t"), "<<<A", "A>>>"), t="z <<<A\n1\n2\nA>>> q") == "1\n2" and one(spark, tx.section(F.col("t"), "<<<B", "B>>>"), t="z") == ""
    assert one(spark, tx.shortened(F.col("t"), 5), t="abcdef") == "abcd…" and one(spark, tx.shortened(F.col("t"), 6), t="abcdef") == "abcdef"


def test_every_key_format_is_redacted(spark):
    keys = ["AIza" + "a" * 35, "sk-or-v1-" + "b" * 24, "sk-ant-" + "c" * 24, "sk-" + "d" * 24]
    text = " ".join(keys) + " Authorization: Bearer " + "e" * 20 + ' x-api-key: "' + "f" * 20 + '" hidden-value-1 short'
    got = one(spark, tx.redacted(F.col("t"), ["hidden-value-1", "short"]), t=text)
    assert got == '<redacted> <redacted> <redacted> <redacted> Authorization: Bearer <redacted> x-api-key: "<redacted>" <redacted> short'
    assert tx.secret_values({"GEMINI_API_KEY": "v", "PATH": "p", "OPENAI_API_KEY": ""}) == ["v"]
    df = spark.sql(f"select map('k', array('{keys[0]}', 'x')) as m, named_struct('a', named_struct('b', '{keys[3]}')) as s, 7 as n, cast(null as struct<c: string>) as z")
    r = tx.redacted_rows(df).first()
    assert (r.m, r.s.a.b, r.n, r.z) == ({"k": ["<redacted>", "x"]}, "<redacted>", 7, None)


def test_names_on_pages(spark):
    cases = [("Prof. Dr.-Ing. Ada Byron", "we met ada byron", True), ("Byron, Ada", "ada of the byron group", True), ("Ada Byron", "adam byron", False), ("Dr. Li", "li is here", False), ("", "x", False), ("Ünal Öz", "öz and ünal", True)]
    df = spark.createDataFrame([c[:2] for c in cases], "n string, p string")
    assert [r.ok for r in df.select(tx.name_on_page(F.col("n"), F.col("p")).alias("ok")).collect()] == [c[2] for c in cases]


def naive_quote(q, page, threshold=0.85):
    import difflib

    q = q.strip(" .\"'")
    if len(q) < 8:
        return False
    m = difflib.SequenceMatcher(None, page, q, autojunk=False).find_longest_match(0, len(page), 0, len(q))
    pieces = [c.strip() for c in q.replace("…", "...").split("...") if len(c.strip()) >= 20]
    return q in page or m.size / len(q) >= threshold or bool(pieces) and all(c in page for c in pieces)


def test_quotes_equal_a_longest_common_substring(spark):
    rng = random.Random(2)
    pages = [" ".join(rng.choice(["wonderful", "morning", "sky", "at", "noon", "extraordinarily", "blue"]) for _ in range(60)) for _ in range(12)]
    said = ['"wonderful morning sky', "extraordinarily", "short", "… …"]
    for _ in range(60):
        page = rng.choice(pages)
        at, n = rng.randrange(200), rng.randrange(5, 90)
        q = page[at : at + n]
        kind = rng.randrange(4)
        said.append(q if kind == 0 else q + "x" * rng.randrange(1, 12) if kind == 1 else q[: n // 2] + "#" + q[n // 2 :] if kind == 2 else page[:30] + " ... " + page[-30:])
    q = spark.createDataFrame(list(enumerate(said)), "quote_id long, quote string")
    p = spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string")
    want = sorted((i, j) for i, x in enumerate(said) for j, y in enumerate(pages) if naive_quote(x, y))
    assert sorted((r.quote_id, r.doc_id) for r in quotes.found(q, p).collect()) == want
    # the same, with few quotes to a block
    assert sorted((r.quote_id, r.doc_id) for r in quotes.found(q, p, block=20).collect()) == want


def test_fetched_answers(spark):
    rows = [
        ("https://A.example/x#y", 200, {"CONTENT-TYPE": "text/html; charset=utf-8", "X-Robots-Tag": "pagebot: noindex, all", "retry-after": "7"}, bytearray("<p>äbc".encode()), None, 0, None),
        ("https://a.example/y", 200, {}, bytearray(b"  <!DOCTYPE html>"), "https://a.example/z?utm_x=1", 6, None),
        ("https://a.example/w", None, None, None, None, None, "e" * 600),
    ]
    df = spark.createDataFrame(rows, "url string, status int, headers map<string,string>, body binary, final_url string, redirects int, error string")
    a, b, c = snapshots.answers(df, max_bytes=4).collect()
    assert (a.final_url, a.bytes, a.truncated, a.text, a.is_html, a.x_robots, a.retry_after) == ("https://a.example/x", 4, True, "<p>Ã", True, ["pagebot", "noindex", "all"], 7.0)
    assert (b.status, b.error, b.final_url, b.text) == (0, "too many redirects", "https://a.example/z", "")
    assert (c.status, len(c.error), c.bytes, c.is_html) == (0, 500, 0, False)


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_sources(spark, tmp_path, kind):
    df = spark.sql("select 'https://a.example/' as url, 200 as status, map('a', 'b') as headers, 'x' as body, cast(null as string) as final_url, 0 as redirects, cast(null as string) as error")
    path = f"{tmp_path}/{kind}"
    (df.withColumn("body", F.encode("body", "utf-8")).write.parquet(path) if kind == "parquet" else df.write.json(path))
    assert bytes(snapshots.source(kind, path).fetches(spark).first().body) == b"x"
    with pytest.raises(snapshots.ConfigError):
        snapshots.source("ftp", path)


def test_word_lists():
    assert len(lx.POSITION) == 49 and len(lx.FUNDING) == 42 and len(lx.NEGATIVE_FUNDING) == 10 and len(lx.RECORD_COLUMNS) == 32
    assert (len(lx.PEOPLE_PATH), len(lx.RESEARCH_PATH), len(lx.JOBS_PATH), len(lx.LOW_VALUE_PATH), len(lx.NON_HTML)) == (22, 15, 21, 34, 49)


def test_german_terms(spark):
    text = "Wir bieten eine Stellenausschreibung für Doktorandinnen, TV-L E 13, Vergütung. Offene Stellen: Doktorandin!"
    r = spark.createDataFrame([(text,)], "t string").select(tx.signals(F.col("t"), ["optik", "für"]).alias("s")).first().s
    assert r.position == ["stellenausschreibung", "offene stellen", "doktorandin"] and r.funding == ["tv-l", "e 13", "vergütung"] and r.fields == ["für"] and r.degrees == ["phd"]


def test_canonical_cases(spark):
    cases = {
        "HTTP://U:p@A.Example.:80/a/../b//c/?utm_x=1&q=a%20b&flag#f": "http://a.example/b/c/?q=a+b&flag=",
        "https://h:8443/x?fbclid=1": "https://h:8443/x",
        "ftp://h/x": None,
        "tel:1": None,
        "https://h:99999/": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.canonical(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == cases
