"""Text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import lexicons as lx


def _java_quote(term: str) -> str:
    return re.sub(r"([\\.*+?()\[\]{}^$|])", r"\\\1", term)


def either(words: list[str]) -> str:
    """A group of alternatives, each word as it stands."""
    return "(?:" + "|".join(map(_java_quote, words)) + ")"


_LOCAL = "[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}"
_LABEL = "(?!-)[A-Za-z0-9-]{1,64}(?<!-)"
#: One address; what stands around it must not continue it.
EMAIL = rf"(?U)(?<![\w.+-])({_LOCAL}@(?:{_LABEL}\.)+[A-Za-z]{{2,24}})(?![\w-])"
_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_AT = rf"(?:{_OPEN}{either(lx.AT_WORDS)}{_CLOSE}|\s{either(lx.AT_BETWEEN_BLANKS)}\s)"
_DOT = rf"(?:\s*{_OPEN}{either(lx.DOT_WORDS)}{_CLOSE}\s*|\.)"
#: An address with its signs written out: the local part and the domain.
OBFUSCATED = rf"({_LOCAL})\s*{_AT}\s*([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+)"
_NAME_TITLES = rf"(?iU)\b{either(lx.NAME_TITLES)}\b\.?-?"
_KEY_TITLES = rf"(?U)\b{either(lx.KEY_TITLES)}\b\.?"
ACADEMIC_TITLE = rf"(?U)\b{either(lx.ACADEMIC_TITLES)}(?!\w)"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once, also inside lambdas, where Spark does not share subexpressions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def named(**fields: Column) -> Column:
    """A struct whose names do not hang on aliases, which Spark drops next to a generator."""
    return F.named_struct(*(x for k, v in fields.items() for x in (F.lit(k), v)))


def _branches(terms: list[str]) -> str:
    """Alternation by first character, so that a position looks at few terms; longer terms come first."""
    heads: dict[str, list[str]] = {}
    for t in terms:
        heads.setdefault(t[:1], []).append(t[1:])
    last = "" in heads
    out = [_java_quote(h) + (f"(?:{_branches(rest)})" if len(rest) > 1 else _java_quote(rest[0])) for h, rest in sorted(heads.items()) if h]
    return "|".join(out + [""] * last)


def lexicon_regex(terms: list[str]) -> str:
    """Longest term first, between word boundaries, in any case. A look at the first character spares most positions the rest."""
    known = sorted({t.lower() for t in terms if t})
    heads = "".join(h if h.isalnum() else f"\\{h}" for h in sorted({t[0] for t in known}))
    return rf"(?iU)(?=[{heads}])(?<!\w)({_branches(known)})(?!\w)"


def lexicon_hits(text: Column, terms: list[str]) -> Column:
    """Terms found, leftmost and not overlapping, lower-case, in order of first occurrence."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(lexicon_regex(terms)), 1), F.lower))


def degree_levels(text: Column) -> Column:
    """Levels any of whose terms is a substring; so 'msca' counts as 'msc'."""
    low = F.lower(text)
    found = [F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)), F.lit(level)) for level, terms in lx.DEGREES.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def signals(text: Column, fields: list[str], position: list[str] | None = None, funding: list[str] | None = None, negative: list[str] | None = None) -> Column:
    """struct<position, funding, negative, degrees, fields> of arrays."""
    return F.struct(
        lexicon_hits(text, position or lx.POSITION).alias("position"),
        lexicon_hits(text, funding or lx.FUNDING).alias("funding"),
        lexicon_hits(text, negative or lx.NEGATIVE_FUNDING).alias("negative"),
        degree_levels(text).alias("degrees"),
        lexicon_hits(text, fields).alias("fields"),
    )


def prefilter_reason(length: Column, kind: Column, position: Column, funding: Column, negative: Column, field: Column, mode: str = "loose", least: int = 200) -> Column:
    """First rule that applies; position, funding, negative, field are booleans."""
    strict = F.lit(mode == "strict")
    return (
        F.when(length < least, "too_little_text")
        .when(kind == "listing", "listing_page_follow_links_instead")
        .when(F.lit(mode == "off"), "prefilter_off")
        .when(negative & ~funding, "page_states_no_funding")
        .when(strict & (position | funding) & field, "position_or_funding_and_field_terms")
        .when(strict, "strict_needs_position_and_field_terms")
        .when((kind == "position") & (position | funding), "position_page")
        .when((kind == "profile") & field, "profile_with_field_terms")
        .when(position & (funding | field), "position_terms_with_funding_or_field")
        .when((kind == "profile") & position, "profile_mentions_openings")
        .otherwise("no_position_or_field_signal")
    )


ACCEPTED = ["prefilter_off", "position_or_funding_and_field_terms", "position_page", "profile_with_field_terms", "position_terms_with_funding_or_field", "profile_mentions_openings"]


def clean_emails(found: Column) -> Column:
    """Lower-case addresses without image and code endings, in order, each once."""
    around = r"""^[.,;:<>()\[\]"'\s]+|[.,;:<>()\[\]"'\s]+$"""
    low = F.transform(found, lambda e: F.lower(F.regexp_replace(e, around, "")))
    whole = F.lit(f"^{EMAIL}$")
    return F.array_distinct(F.filter(low, lambda e: F.regexp_like(e, whole) & ~F.regexp_extract(e, r"\.([a-z]+)$", 1).isin(lx.NOT_MAIL_TLDS)))


def plain_emails(text: Column) -> Column:
    return clean_emails(found_emails(text))


def found_emails(text: Column) -> Column:
    """Plain addresses as they stand; texts without the sign skip the search."""
    return F.when(~F.contains(text, F.lit("@")), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(EMAIL), 1))


def obfuscated_emails(text: Column) -> Column:
    rx = F.lit("(?iu)" + OBFUSCATED)
    pairs = F.arrays_zip(F.regexp_extract_all(text, rx, 1).alias("l"), F.regexp_extract_all(text, rx, 2).alias("d"))
    found = F.transform(pairs, lambda p: F.concat(p["l"], F.lit("@"), F.regexp_replace(p["d"], "(?iu)" + _DOT, ".")))
    # every match holds the sign's stand-in, which is quick to rule out
    return clean_emails(F.when(~text.rlike("(?iu)" + _AT), F.array().cast("array<string>")).otherwise(found))


def decode_protected(hexed: Column) -> Column:
    """Address hidden as hexadecimal bytes, the first of them the XOR key (a last single digit is a byte); other input gives NULL."""
    byte = lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("int")
    at = F.when(F.length(hexed) > 2, F.sequence(F.lit(3), F.greatest(F.length(hexed), F.lit(3)), F.lit(2))).otherwise(F.array().cast("array<int>"))
    plain = F.array_join(F.transform(at, lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(1))))), "")
    return F.when(hexed.rlike("^[0-9A-Fa-f]+$"), plain)


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    # not by .str, which ties a batch to itself: a worker would hold all its texts until the collector of cycles happens to run
    return values.map(lambda v: None if pd.isna(v) else normalize("NFKC", v))


def match_form(text: Column, compose: bool = False) -> Column:
    """Lower case, straight quotes, plain hyphens, single blanks. compose: NFKC first, which Spark lacks, in an Arrow batch."""
    base = nfkc(text) if compose else text
    plain = F.translate(F.lower(base), "‘’“”‐‑‒–—―", "''\"\"------")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def stripped_quote(quote: Column) -> Column:
    """A quote in match form without the marks around it."""
    return F.regexp_replace(quote, r"""^[ ."']+|[ ."']+$""", "")


def quote_pieces(quote: Column) -> Column:
    """What stands around the ellipses of a quote."""
    return F.transform(F.split(quote, r"\.\.\.|…"), lambda p: F.trim(p))


def quote_on_page(quote: Column, page: Column, threshold: float = 0.85) -> Column:
    """Both in match form. True if the quote, a stretch of at least the threshold of it, or all its pieces around an ellipsis occur.

    Any such stretch holds the middle of the quote, so that a page without it needs no further look.
    """

    def test(q: Column) -> Column:
        n = F.length(q)
        least = F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")
        middle = F.contains(page, F.substring(q, n - least + 1, F.greatest(2 * least - n, F.lit(1))))
        window = F.exists(F.sequence(F.lit(1), F.greatest(n - least + 1, F.lit(1))), lambda i: F.contains(page, F.substring(q, i, least)))
        pieces = F.filter(quote_pieces(q), lambda p: F.length(p) >= 20)
        all_pieces = (F.size(pieces) > 0) & F.forall(pieces, lambda p: F.contains(page, p))
        return F.coalesce((n >= 8) & ((middle & window) | all_pieces), F.lit(False))

    return bound(stripped_quote(quote), test)


def name_on_page(name: Column, page: Column) -> Column:
    """Page in match form. The name without titles occurs, or each of two or more parts does as a word."""
    bare = F.regexp_replace(match_form(F.regexp_replace(name, _NAME_TITLES, " ")), "^[ .,]+|[ .,]+$", "")
    parts = F.filter(F.split(bare, r"[\s,.]+"), lambda p: F.length(p) >= 2)
    whole = lambda p: F.regexp_like(page, F.concat(F.lit(r"(?U)(?<!\w)\Q"), p, F.lit(r"\E(?!\w)")))
    return F.coalesce((F.length(bare) >= 3) & (F.contains(page, bare) | ((F.size(parts) >= 2) & F.forall(parts, whole))), F.lit(False))


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), _KEY_TITLES, " "), "[^a-zäöüß]+", " "))


def truncated(text: Column, limit: int) -> Column:
    head = int(limit * 0.8)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(lx.CUT_MARK), F.right(text, F.lit(limit - head))))


def first_sentence_with(text: Column, terms: list[str]) -> Column:
    """First sentence of more than 15 characters with any of the terms, at most 300 characters, else NULL."""
    sentences = F.split(text, r"(?<=[.!?])\s+|\n")
    fits = F.filter(sentences, lambda s: (F.length(s) > 15) & F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(s), t)))
    return F.left(F.trim(F.get(fits, F.lit(0))), F.lit(300))


def section(text: Column, start: str, end: str) -> Column:
    """What stands between two marker lines, else ''."""
    return F.regexp_extract(text, rf"(?s){_java_quote(start)}\n(.*?)\n{_java_quote(end)}", 1)


def shortened(value: Column, limit: int) -> Column:
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit - 1)), F.lit("…"))).otherwise(value)


def redacted(text: Column, values: list[str] | None = None, patterns: list[str] | None = None) -> Column:
    """Known values of 8 characters and more, then each pattern, replaced; a pattern's group is kept."""
    for v in values or []:
        if len(v) >= 8:
            text = F.replace(text, F.lit(v), F.lit("<redacted>"))
    for p in lx.SECRETS if patterns is None else patterns:
        groups = re.compile(p).groups
        text = F.regexp_replace(text, F.lit(p), F.lit("$1<redacted>" if groups else "<redacted>"))
    return text


def secret_values(environment: dict[str, str]) -> list[str]:
    """Values of the variables that hold keys, for redacted()."""
    return [environment[k] for k in lx.SECRET_VARIABLES if environment.get(k)]


def redacted_all(value: Column, kind: T.DataType, values: list[str] | None = None, patterns: list[str] | None = None) -> Column:
    """redacted() on every string inside a value of any type: fields of structs, elements of arrays, values of maps."""
    inner = lambda v, k: redacted_all(v, k, values, patterns)
    if isinstance(kind, T.StringType):
        return redacted(value, values, patterns)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: inner(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: inner(v, kind.valueType))
    if isinstance(kind, T.StructType):
        made = F.struct(*(inner(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), made)
    return value


def redacted_rows(df: DataFrame, values: list[str] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """df with every string of every column redacted."""
    return df.select(*(redacted_all(F.col(f"`{f.name}`"), f.dataType, values, patterns).alias(f.name) for f in df.schema.fields))


def unique_lines(text: Column) -> Column:
    """Stripped lines that are not empty, each once, in order."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"), lambda x: F.trim(x))
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n")


def safe_cell(value: Column) -> Column:
    """A quote before what a spreadsheet would run as a formula, but not before plain numbers."""
    return F.when(value.rlike(r"^[=+\-@\t\r]") & ~value.rlike(r"^-?\d+(\.\d+)?$"), F.concat(F.lit("'"), value)).otherwise(value)


@F.pandas_udf(T.StringType())
def two_decimals(values: pd.Series) -> pd.Series:
    """The exact binary value with two decimals, ties to even; Java's formatter would round its shortest decimal form half up."""
    return values.map(lambda v: None if pd.isna(v) else f"{v:.2f}")


def joined_cell(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), " | ")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat(*(x for p in parts for x in (p, F.lit("\0")))), 256)
