"""URL functions on absolute URLs, as Column expressions. Invalid input gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import lexicons as lx
from .text import bound, either, named

_TRACKING = rf"(?i)^(?:{lx.TRACKING_PREFIX}[a-z]+|{'|'.join(lx.TRACKING_NAMES)})$"
SKIPPED = rf"(?i)^\s*{either(lx.SKIP_PREFIXES)}"
_PARTS = r"^(?i)(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def _host_port(authority: Column) -> tuple[Column, Column]:
    plain = F.lower(F.regexp_replace(authority, "^.*@", ""))
    return F.regexp_replace(F.regexp_replace(plain, r":\d*$", ""), r"\.$", ""), F.regexp_extract(plain, r":(\d+)$", 1)


def _clean_path(path: Column) -> Column:
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    lead = F.when(path.startswith("//") & ~path.startswith("///"), "//").otherwise("/")
    body = F.concat(lead, F.array_join(kept, "/"))
    return F.when(path.endswith("/") & ~body.endswith("/"), F.concat(body, F.lit("/"))).otherwise(body)


def _encoded(value: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(value), value)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _clean_query(query: Column) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.filter(pairs, lambda p: ~F.regexp_like(F.regexp_extract(p, "^([^=]*)", 1), F.lit(_TRACKING)))
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(F.regexp_extract(p, "^([^=]*)", 1)), F.lit("="), _encoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)))), "&")


def canonical(url: Column) -> Column:
    """Canonical form of an absolute http(s) URL, else NULL."""
    def assembled(p: Column) -> Column:
        usual = (p["port"] == "") | ((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443"))
        valid = (F.length(p["port"]) <= 5) & (F.coalesce(F.try_to_number(F.when(p["port"] == "", "0").otherwise(p["port"]), F.lit("99999")), F.lit(0)) <= 65535)
        port = F.when(usual, "").otherwise(F.concat(F.lit(":"), p["port"]))
        query = F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"]))
        return F.when((p["scheme"] != "") & (p["host"] != "") & valid, F.concat(p["scheme"], F.lit("://"), p["host"], port, p["path"], query))

    def parts(u: Column) -> Column:
        host, port = _host_port(_part(u, 2))
        path = bound(_part(u, 3), lambda x: F.when(x == "", "/").otherwise(_clean_path(x)))
        return named(scheme=F.lower(_part(u, 1)), host=host, port=port, path=path, query=_clean_query(_part(u, 4)))

    return bound(F.trim(url), lambda u: F.when(~u.rlike(SKIPPED), bound(parts(u), assembled)))


def host_of(url: Column) -> Column:
    return F.nullif(_host_port(_part(url, 2))[0], F.lit(""))


def origin_of(url: Column) -> Column:
    """Scheme and host; ports 80 and 443 are left out whatever the scheme."""
    host, port = _host_port(_part(url, 2))
    return F.when(host != "", F.concat(F.lower(_part(url, 1)), F.lit("://"), host, F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))))


def path_of(url: Column) -> Column:
    return F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))


def path_and_query(url: Column) -> Column:
    return F.concat(path_of(url), F.when(_part(url, 4) == "", "").otherwise(F.concat(F.lit("?"), _part(url, 4))))


def in_scope(host: Column, domains: list[str]) -> Column:
    """Host equals a domain or lies under it."""
    out = F.lit(False)
    for d in domains:
        d = d.lower()
        out = out | (host == d) | host.endswith(f".{d}")
    return F.coalesce(out, F.lit(False))


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it: an equi-join key for large scope tables."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def looks_like_html(url: Column) -> Column:
    name = F.regexp_extract(path_of(url), "([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r"^.*[^.].*(\.[^.]*)$|^[^.].*?(\.[^.]*)$", 0))
    extension = F.when(extension == "", "").otherwise(F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)))
    return ~extension.isin(lx.NON_HTML)


def slug(text: Column, limit: int = 40) -> Column:
    out = F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(limit)), "-+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "item").otherwise(out)


def profile_kind(url: Column) -> Column:
    """Kind of a link to a person's profile page, else NULL; the first host that fits decides."""

    def kind_of(p: Column) -> Column:
        host, path, query = p["host"], p["path"], p["query"]
        slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
        begins = lambda parts: path.rlike("^" + either(parts))
        ok = {kind: begins(parts) for kind, parts in lx.PROFILE_PATHS.items()} | {
            "github": slashes.isin(1, 2) & (F.regexp_replace(path, "^/+|/+$", "") != "") & ~begins(lx.GITHUB_OTHER),
            "google_scholar": query.contains("user="),
            "orcid": path.rlike(lx.ORCID_PATH),
            "x": (slashes == 1) & (F.length(path) > 1) & ~F.regexp_replace(path, "^/", "").isin(lx.X_OTHER),
        }
        out = F.lit(None).cast("string")
        for kind, pattern in reversed(lx.PROFILE_HOSTS.items()):
            out = F.when(host.rlike(pattern), F.when(ok[kind], kind)).otherwise(out)
        return out

    return bound(named(host=host_of(url), path=path_of(url), query=_part(url, 4)), kind_of)


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9~äöüß]+"), lambda t: t != ""))


def link_score(url: Column, anchor: Column, fields: list[str], position: list[str] | None = None) -> Column:
    """Priority of a link: jobs +6, people +4, research +3, field term +3, low value -5. Tokens come from the whole URL."""
    tokens = tokens_of(url)
    low, said = F.lower(F.concat_ws(" ", url, anchor)), F.lower(F.coalesce(anchor, F.lit("")))
    hit = lambda terms: F.arrays_overlap(tokens, F.array(*map(F.lit, terms)))
    phrase = lambda text, terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)) if terms else F.lit(False)
    return (
        F.when(hit(lx.JOBS_PATH) | phrase(said, position or lx.POSITION), 6).otherwise(0)
        + F.when(hit(lx.PEOPLE_PATH) | url.contains("/~"), 4).otherwise(0)
        + F.when(hit(lx.RESEARCH_PATH), 3).otherwise(0)
        + F.when(phrase(low, [f.lower() for f in fields]), 3).otherwise(0)
        - F.when(hit(lx.LOW_VALUE_PATH), 5).otherwise(0)
    ).cast("int")
