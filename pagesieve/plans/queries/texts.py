"""Text functions over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import lexicons as lx, text as tx
from ...operators import quotes as qt
from ...sources.snapshots import table
from .base import EMAIL, FIELDS, FUNDING, NEGATIVE, POSITION, PREFILTER, emails, frame, hits, literal, match_form, ordered_distinct, query, values


@query("""select doc_id, coalesce(string_agg(line, chr(10) order by k), '') as text from (
  select doc_id, line, min(k) as k from (select doc_id, trim(unnest(string_split(text, chr(10)))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)
  where line <> '' group by doc_id, line)
  group by doc_id union all select doc_id, '' from documents where trim(replace(text, chr(10), ' ')) = ''""")
def line_dedupe(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.unique_lines(F.col("text")).alias("text"))


@query(f"select doc_id, array_to_string({emails('text')}, ' ') as emails from documents where contains(text, '@')")
def emails_plain(spark, d):
    return table(spark, d, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", F.array_join(tx.plain_emails(F.col("text")), " ").alias("emails"))


_HIDDEN = [("mail jane.doe [at] uni-x [dot] de now",), ("a(at)b.org or c {AT} d {dot} edu",), ("nobody at home",), ("x ät y.org, x <ät> y punkt org",)]
_DISGUISED = f"select text from {values(_HIDDEN, 'text')} union all select replace(text, '@', case doc_id % 3 when 0 then ' [at] ' when 1 then '(AT)' else ' ät ' end) as text from documents where contains(text, '@')"
_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_SIGN = rf"(?:{_OPEN}(?:at|ät|@){_CLOSE}|\s(?:ät|＠)\s)"
_POINT = rf"(?:\s*{_OPEN}(?:dot|punkt|[.]){_CLOSE}\s*|[.])"
_WRITTEN = rf"([A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}})\s*{_SIGN}\s*([A-Za-z0-9-]+(?:{_POINT}[A-Za-z0-9-]+)+)"
_FOUND = f"list_zip(regexp_extract_all(text, '{_WRITTEN}', 1, 'i'), regexp_extract_all(text, '{_WRITTEN}', 2, 'i'))"
_JOINED = f"list_transform({_FOUND}, lambda p: lower(p[1] || '@' || regexp_replace(p[2], '{_POINT}', '.', 'gi')))"


@query(f"select md5(text) as digest, array_to_string({ordered_distinct(f'list_filter({_JOINED}, lambda e: regexp_full_match(e, {literal(EMAIL)}))')}, ' ') as emails from ({_DISGUISED})")
def emails_obfuscated(spark, d):
    """Addresses written out: own cases, and those of the documents with their sign replaced."""
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("@")))
    sign = F.when(F.col("doc_id") % 3 == 0, " [at] ").when(F.col("doc_id") % 3 == 1, "(AT)").otherwise(" ät ")
    both = frame(spark, _HIDDEN, "text string").unionAll(docs.select(F.replace("text", F.lit("@"), sign).alias("text")))
    return both.select(F.md5("text").alias("digest"), F.array_join(tx.obfuscated_emails(F.col("text")), " ").alias("emails"))


_CODES = [("2",), ("zz11",), ("2a4b6a0",), ("",)]


@query(f"""select doc_id, lower(e) as email, lower(e) as decoded from (select doc_id, unnest({emails('text')}) as e from documents where contains(text, '@'))
 union all select -1, code, case when regexp_full_match(code, '[0-9a-f]+') then array_to_string(list_transform(range(3, length(code) + 1, 2), lambda i: chr(xor(('0x' || substr(code, i, 2))::int, ('0x' || substr(code, 1, 2))::int))), '') end
 from {values(_CODES, 'code')}""")
def cfemail_decode(spark, d):
    """Addresses of the documents, hidden under a key of their document and shown again."""
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("@")))
    mails = docs.select("doc_id", F.explode(tx.plain_emails(F.col("text"))).alias("email"))
    key = (F.col("doc_id") % 200 + 1).cast("int")
    byte = lambda v: F.lpad(F.lower(F.hex(v)), 2, "0")
    letters = F.transform(F.sequence(F.lit(1), F.length("email")), lambda i: byte(F.ascii(F.substring("email", i, F.lit(1))).bitwiseXOR(key).cast("bigint")))
    hidden = mails.select("doc_id", "email", F.concat(byte(key.cast("bigint")), F.array_join(letters, "")).alias("code"))
    own = frame(spark, [(-1, c, c) for (c,) in _CODES], "doc_id long, email string, code string")
    return hidden.unionByName(own).select("doc_id", "email", tx.decode_protected(F.col("code")).alias("decoded"))


_LISTS = {"position": POSITION, "funding": FUNDING, "negative": NEGATIVE, "field": FIELDS}


@query(f"select doc_id, {', '.join(f'array_to_string({hits(chr(116) + chr(101) + chr(120) + chr(116), t)}, chr(124)) as {n}' for n, t in _LISTS.items())} from documents")
def lexicon_signals(spark, d):
    """Terms found per list, in order of their first occurrence."""
    s = table(spark, d, "documents").select("doc_id", tx.signals(F.col("text"), FIELDS, POSITION, FUNDING, NEGATIVE).alias("s"))
    return s.select("doc_id", *(F.array_join(f"s.{c}", "|").alias(n) for c, n in (("position", "position"), ("funding", "funding"), ("negative", "negative"), ("fields", "field"))))


_LEVELS = [("A PhD or MSc",), ("msca post-doc",), ("promotion",), ("nothing",)]
_LEVEL = ", ".join(f"case when {' or '.join(f'contains(lower(text), {literal(t)})' for t in terms)} then {literal(k)} end" for k, terms in lx.DEGREES.items())


@query(f"select text, array_to_string(list_filter([{_LEVEL}], lambda x: x is not null), ' ') as levels from (select text from documents union all select text from {values(_LEVELS, 'text')})")
def degree_levels(spark, d):
    both = table(spark, d, "documents").select("text").unionAll(frame(spark, _LEVELS, "text string"))
    return both.select("text", F.array_join(tx.degree_levels(F.col("text")), " ").alias("levels"))


_KIND = "case doc_id % 4 when 0 then 'position' when 1 then 'profile' when 2 then 'other' else case when doc_id % 3 = 0 then 'listing' else 'other' end end"
_SIGNS = ", ".join(f"len({hits('text', t)}) > 0 as {n}" for n, t in _LISTS.items())


@query(f"select doc_id, {PREFILTER} as reason from (select doc_id, text, {_KIND} as kind, {_SIGNS} from documents)")
def signal_prefilter(spark, d):
    s = table(spark, d, "documents").select("doc_id", "text", F.expr(_KIND).alias("kind"), tx.signals(F.col("text"), FIELDS, POSITION, FUNDING, NEGATIVE).alias("s"))
    has = lambda c: F.size(f"s.{c}") > 0
    return s.select("doc_id", tx.prefilter_reason(F.length("text"), F.col("kind"), has("position"), has("funding"), has("negative"), has("fields")).alias("reason"))


@query("select doc_id, md5(case when length(text) <= 1000 then text else left(text, 800) || chr(10) || '[... truncated ...]' || chr(10) || right(text, 200) end) as digest from documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.truncated(F.col("text"), 1000)).alias("digest"))


@query("select doc_id, sha256(lang || chr(0) || source || chr(0) || text || chr(0)) as cache_key from documents")
def cache_key(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.cache_key(F.col("lang"), F.col("source"), F.col("text")).alias("cache_key"))


# Quotes: benchmark texts as they are, begun with a mark, with a changed end, with a piece left out, and their longest word.
_VARIANTS = """select item_id * 10 as quote_id, text as quote from benchmark union all select item_id * 10 + 1, '"' || left(text, 60) from benchmark
 union all select item_id * 10 + 2, left(text, 90) || 'zqzqzq' from benchmark union all select item_id * 10 + 3, left(text, 40) || ' ... ' || right(text, 40) from benchmark
 union all select item_id * 10 + 4, list_sort(string_split(text, ' '), 'DESC')[1] from benchmark"""
_QUOTE = f"trim({match_form('quote')}, ' .\"''')"
_PIECES = "list_filter(list_transform(string_split_regex(q, '[.]{3}|…'), lambda p: trim(p)), lambda p: length(p) >= 20)"
_NEED = "ceil(length(q) * 0.85 - 1e-9)::int"
_WINDOWS = f"len(list_filter(range(1, greatest(length(q) - {_NEED} + 1, 1) + 1), lambda i: contains(page, substr(q, i, {_NEED})))) > 0"


@query(f"""select quote_id, doc_id from (select quote_id, {_QUOTE} as q from ({_VARIANTS})), (select doc_id, {match_form('text')} as page from documents)
 where length(q) >= 8 and (contains(page, q) or (contains(page, substr(q, length(q) - {_NEED} + 1, 2 * {_NEED} - length(q))) and {_WINDOWS})
  or (len({_PIECES}) > 0 and len(list_filter({_PIECES}, lambda p: not contains(page, p))) = 0))""")
def quote_verify(spark, d):
    """Which documents hold which quotes, small copying errors allowed."""
    b = table(spark, d, "benchmark").select("item_id", "text")
    word = F.element_at(F.sort_array(F.split("text", " "), asc=False), 1)
    forms = [F.col("text"), F.concat(F.lit('"'), F.left("text", F.lit(60))), F.concat(F.left("text", F.lit(90)), F.lit("zqzqzq")), F.concat(F.left("text", F.lit(40)), F.lit(" ... "), F.right("text", F.lit(40))), word]
    quotes = b.select(F.posexplode(F.array(*forms)).alias("k", "quote"), "item_id").select((F.col("item_id") * 10 + F.col("k")).alias("quote_id"), "quote")
    return qt.found(quotes, table(spark, d, "documents").select("doc_id", "text"))


_NAMES = [("Prof. Dr. Ada Byron", "we met ada byron today"), ("Byron, Ada", "ada of the byron group"), ("Dr. Ad", "ad hoc"), ("Ada Byron", "adam byron"), ("Xy", "xy"), ("Prof. Ann-Mary Lee", "ann-mary and lee")]
_NAMED = f"""select name, page from {values(_NAMES, 'name, page')} union all
 select 'Prof. Dr. ' || string_split(text, ' ')[3] || ' ' || string_split(text, ' ')[8 + doc_id % 5], {match_form('text')} from documents where len(string_split(text, ' ')) > 14"""
_BARE = f"""trim({match_form("regexp_replace(name, '(?i)(^|[^a-z0-9_])(?:prof|professor|professorin|dr|phd|ph[.]d|habil|univ|mag|dipl|ing|rer|nat|mr|ms|mrs)(?:[.]-?|-|$|( ))', '\\1 \\2', 'g')")}, ' .,')"""


def _word(p: str) -> str:
    return f"regexp_matches(page, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape({p}) || '($|[^\\p{{L}}\\p{{N}}_])')"


_PARTS = "list_filter(string_split_regex(bare, '[\\s,.]+'), lambda p: length(p) >= 2)"


@query(f"""select name, md5(page) as digest, length(bare) >= 3 and (contains(page, bare) or (len({_PARTS}) >= 2 and len(list_filter({_PARTS}, lambda p: not {_word('p')})) = 0)) as ok
 from (select name, page, {_BARE} as bare from ({_NAMED}))""")
def name_verify(spark, d):
    """Own names, and of each document two of its words as a name."""
    words = F.split("text", " ")
    docs = table(spark, d, "documents").where(F.size(words) > 14)
    name = F.concat(F.lit("Prof. Dr. "), F.get(words, F.lit(2)), F.lit(" "), F.get(words, (F.lit(7) + F.col("doc_id") % 5).cast("int")))
    both = frame(spark, _NAMES, "name string, page string").unionAll(docs.select(name, tx.match_form(F.col("text"))))
    return both.select("name", F.md5("page").alias("digest"), tx.name_on_page(F.col("name"), F.col("page")).alias("ok"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(text, '(token = ")[0-9a-f]{40}', '\1<redacted>', 'g'), '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}', '<redacted>', 'g')) as digest from documents""")
def redact_text(spark, d):
    own = [r'(token = ")[0-9a-f]{40}', r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"]
    return table(spark, d, "documents").select("doc_id", F.md5(tx.redacted(F.col("text"), patterns=own)).alias("digest"))


_KEYED = """case doc_id % 7 when 0 then 'AIza' || md5(text) when 1 then 'sk-or-v1-' || md5(text) when 2 then 'sk-ant-' || md5(text) when 3 then 'my sk-' || md5(text)
 when 4 then 'Authorization: Bearer ' || md5(text) when 5 then 'x-goog-api-key: "' || md5(text) || '"' else 'task-' || md5(text) end"""
_REDACTED = "said"
for _p in lx.SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, {literal(_p)}, {literal(chr(92) + '1<redacted>' if '(bearer' in _p or '(x-' in _p else '<redacted>')}, 'g')"


@query(f"select doc_id, {_REDACTED} as shown, {{'inner': {_REDACTED}, 'n': 1}}.inner as inside from (select doc_id, {_KEYED} || ' and ' || left(text, 20) as said from documents)")
def redact_keys(spark, d):
    """Every kind of key, made of each document's digest; inside a struct as well."""
    digest, k = F.md5("text"), F.col("doc_id") % 7
    forms = ["AIza", "sk-or-v1-", "sk-ant-", "my sk-", "Authorization: Bearer ", 'x-goog-api-key: "', "task-"]
    key = F.concat(F.element_at(F.array(*map(F.lit, forms)), (k + 1).cast("int")), digest, F.when(k == 5, '"').otherwise(""))
    said = F.concat(key, F.lit(" and "), F.left("text", F.lit(20)))
    rows = table(spark, d, "documents").select("doc_id", said.alias("shown"), F.struct(said.alias("inner"), F.lit(1).alias("n")).alias("box"))
    return tx.redacted_rows(rows).select("doc_id", "shown", F.col("box.inner").alias("inside"))


_CELLS = [("=1+1",), ("-5",), ("-5.25",), ("-x",), ("@a",), ("+49 1",), ("a=b",), ("",), ("\tx",)]


@query(f"""select value, case when regexp_matches(value, '^[=+\\-@\\t\\r]') and not regexp_full_match(value, '-?[0-9]+([.][0-9]+)?') then '''' || value else value end as cell,
 array_to_string(list_filter([left(value, 1), '', null, value], lambda v: v <> ''), ' | ') as list
 from (select value from {values(_CELLS, 'value')} union all select ['=', '-', '+', '@', '', ''][doc_id % 6 + 1] || left(text, 12) from documents union all select (50 - value)::varchar from events)""")
def csv_cells(spark, d):
    signs = F.element_at(F.array(*map(F.lit, ["=", "-", "+", "@", "", ""])), (F.col("doc_id") % 6 + 1).cast("int"))
    docs = table(spark, d, "documents").select(F.concat(signs, F.left("text", F.lit(12))).alias("value"))
    numbers = table(spark, d, "events").select((F.lit(50) - F.col("value")).cast("string").alias("value"))
    both = frame(spark, _CELLS, "value string").unionAll(docs).unionAll(numbers)
    v = F.col("value")
    return both.select("value", tx.safe_cell(v).alias("cell"), tx.joined_cell(F.array(F.left(v, F.lit(1)), F.lit(""), F.lit(None), v)).alias("list"))

