"""Settings, profiles and university files: JSON or plain mappings, checked against fixed ranges. Errors name every violation."""

from __future__ import annotations

import json
import os
import re
from collections.abc import MutableMapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicons as lx, urls
from ..operators.decisions import Profile

MIN_DELAY = 2.0
SLUG = r"^[a-z0-9][a-z0-9-]{1,39}$"
LEVELS = ("phd", "master", "postdoc")
#: Least and greatest value of each number, and the choices of each name.
UNIVERSITY_RANGES = {"max_pages": (1, 3000), "max_depth": (0, 6)}
SCORER_RANGES = {
    "temperature": (0, 1),
    "max_output_tokens": (256, 16000),
    "max_page_chars": (2000, 60000),
    "requests_per_minute": (0, 1000),
    "max_calls_per_run": (1, 10000),
    "timeout_seconds": (5, 600),
    "max_retries": (0, 10),
}
CRAWL_RANGES = {"timeout_seconds": (3, 120), "max_bytes": (50_000, 20_000_000), "min_text_chars": (0, float("inf"))}
SECTION_KINDS = ("department", "jobs", "doctoral_school", "group")
PREFILTERS = ("strict", "loose", "off")
_SECRET_NAME = re.compile(rf"(?i)(?:^|[_-])(?:{'|'.join(lx.SECRET_NAMES)})$")


class ConfigError(ValueError):
    """A settings file that cannot be used."""


@dataclass(frozen=True)
class ScorerSettings:
    provider: str = "mock"
    model: str | None = None
    temperature: float = 0.0
    max_output_tokens: int = 2048
    max_page_chars: int = 12000
    requests_per_minute: float = 10
    max_calls_per_run: int = 150
    timeout_seconds: float = 90
    max_retries: int = 4


@dataclass(frozen=True)
class CrawlSettings:
    timeout_seconds: float = 25
    max_bytes: int = 3_000_000
    prefilter: str = "loose"
    min_text_chars: int = 200


@dataclass(frozen=True)
class Settings:
    llm: ScorerSettings = field(default_factory=ScorerSettings)
    crawl: CrawlSettings = field(default_factory=CrawlSettings)
    output_dir: str = "output"
    runs_dir: str = "runs"
    cache_dir: str = ".cache"


def credentials(value: object, at: str = "") -> list[str]:
    """Paths of filled keys that look like credentials."""
    if isinstance(value, dict):
        own = [f"{at}{k}" for k, v in value.items() if _SECRET_NAME.search(str(k)) and v not in (None, "")]
        return own + [p for k, v in value.items() for p in credentials(v, f"{at}{k}.")]
    if isinstance(value, list):
        return [p for v in value for p in credentials(v, at)]
    return []


def mapping(path: str) -> dict:
    """A JSON file (byte order mark allowed) that holds a mapping without credentials."""
    try:
        value = json.loads(Path(path).read_text(encoding="utf-8-sig") or "{}")
    except FileNotFoundError:
        raise ConfigError(f"{path}: not found") from None
    except ValueError as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(value, dict):
        raise ConfigError(f"{path}: the top level has to be a mapping")
    if found := credentials(value):
        raise ConfigError(f"{path}: credentials do not belong in settings: {', '.join(found)}")
    return value


def _outside(value: dict, ranges: dict[str, tuple[float, float]], at: str = "") -> list[str]:
    out = []
    for name, (low, high) in ranges.items():
        v = value.get(name)
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        if name in value and not (number and low <= v <= high and not (name == "requests_per_minute" and v == 0)):
            out.append(f"{at}{name}")
    return out


def _made(kind: type, value: dict):
    return kind(**{f.name: value[f.name] for f in fields(kind) if f.name in value})


def _refuse(path: str, found: list[str]) -> None:
    if found:
        raise ConfigError(f"{path}: {', '.join(found)}")


def settings_of(value: dict, path: str = "settings") -> Settings:
    """Settings with defaults for what is missing."""
    llm, crawl = value.get("llm") or {}, value.get("crawl") or {}
    found = _outside(llm, SCORER_RANGES, "llm.") + _outside(crawl, CRAWL_RANGES, "crawl.")
    if crawl.get("prefilter", "loose") not in PREFILTERS:
        found.append("crawl.prefilter")
    _refuse(path, found)
    plain = {k: value[k] for k in ("output_dir", "runs_dir", "cache_dir") if k in value}
    return Settings(_made(ScorerSettings, llm), _made(CrawlSettings, crawl), **plain)


def profile_of(value: dict, path: str = "profile") -> Profile:
    """A profile: at least one field, known degree levels, thresholds from 0 to 1."""
    found = _outside(value, {"min_field_match": (0, 1), "min_funding_confidence": (0, 1)})
    levels = value.get("target_degree_levels", ["phd"])
    if not value.get("target_fields"):
        found.append("target_fields")
    if not levels or not set(levels) <= set(LEVELS):
        found.append("target_degree_levels")
    _refuse(path, found)
    renamed = {{"accept_partial_funding": "accept_partial", "accept_unclear_funding": "accept_unclear"}.get(k, k): v for k, v in value.items()}
    return _made(Profile, renamed)


def settings(path: str | None) -> Settings:
    """Settings of a file; the defaults where there is none."""
    return settings_of(mapping(path), path) if path and Path(path).exists() else Settings()


def profile(path: str) -> Profile:
    return profile_of(mapping(path), path)


UNIVERSITY = "slug string, name string, country string, languages array<string>, allowed_domains array<string>, sections array<struct<name: string, kind: string, tags: array<string>, seeds: array<string>>>, max_pages int, max_depth int, min_delay_seconds double"


def violations(universities: DataFrame) -> DataFrame:
    """slug, delay (raised to the floor, never an error), violations (names of what is wrong, '' for nothing).

    universities: columns as in UNIVERSITY; nulls stand for the defaults. A seed has to be an http(s) URL inside the
    allowed domains.
    """
    c = universities
    seeds = F.flatten(F.transform("sections", lambda s: F.coalesce(s["seeds"], F.array().cast("array<string>"))))
    domains = F.transform("allowed_domains", F.lower)
    inside = lambda host: F.exists(domains, lambda x: (host == x) | F.endswith(host, F.concat(F.lit("."), x)))
    within = lambda name: F.coalesce(F.col(name), F.lit(UNIVERSITY_RANGES[name][0])).between(*UNIVERSITY_RANGES[name])
    empty = lambda name: F.coalesce(F.size(name), F.lit(0)) == 0
    checks = {
        "slug": ~F.coalesce(F.col("slug").rlike(SLUG), F.lit(False)),
        "max_pages": ~within("max_pages"),
        "max_depth": ~within("max_depth"),
        "allowed_domains": empty("allowed_domains"),
        "sections": empty("sections") | F.exists("sections", lambda s: F.coalesce(F.size(s["seeds"]), F.lit(0)) == 0),
        "section_kind": F.exists("sections", lambda s: ~F.coalesce(s["kind"], F.lit("department")).isin(*SECTION_KINDS)),
        "seed_scheme": F.exists(seeds, lambda s: ~s.rlike("^https?://")),
        "seed_out_of_scope": F.exists(seeds, lambda s: s.rlike("^https?://") & ~F.coalesce(inside(urls.host_of(s)), F.lit(False))),
    }
    found = [F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in checks.items()]
    return c.select("slug", F.greatest(F.coalesce("min_delay_seconds", F.lit(MIN_DELAY)), F.lit(MIN_DELAY)).alias("delay"), F.concat_ws(" ", *found).alias("violations"))


def chosen_sections(universities: DataFrame, tags: list[str]) -> DataFrame:
    """slug, section (name), kind, seed, position: seeds of the sections with one of the tags, or of a kind that always counts; of all sections if none is left.

    Without tags all sections are chosen. Tags compare in any case.
    """
    wanted = F.array(*(F.lit(t.lower()) for t in tags)).cast("array<string>")
    always = lambda s: s["kind"].isin("jobs", "doctoral_school")
    tagged = lambda s: F.arrays_overlap(F.transform(F.coalesce(s["tags"], F.array().cast("array<string>")), F.lower), wanted)
    chosen = F.filter("sections", lambda s: F.coalesce(always(s), F.lit(False)) | tagged(s)) if tags else F.col("sections")
    each = universities.select("slug", F.posexplode(F.when(F.size(chosen) > 0, chosen).otherwise(F.col("sections"))).alias("i", "s"))
    seeds = each.select("slug", "i", F.col("s.name").alias("section"), F.col("s.kind").alias("kind"), F.posexplode("s.seeds").alias("k", "seed"))
    return seeds.select("slug", "section", "kind", "seed", (F.col("i") * 1000 + F.col("k")).alias("position"))


def with_run_options(universities: DataFrame, max_pages: int | None = None) -> DataFrame:
    """universities with max_pages lowered to the option; an option never raises it."""
    pages = F.coalesce("max_pages", F.lit(300))
    return universities.withColumn("max_pages", F.least(pages, F.lit(max_pages)) if max_pages is not None else pages)


def environment_file(path: str, into: MutableMapping[str, str] | None = None) -> list[str]:
    """Names set from a KEY=VALUE file; what is set already wins; values are never returned."""
    into = os.environ if into is None else into
    named = []
    for raw in Path(path).read_text(encoding="utf-8-sig").splitlines() if Path(path).exists() else []:
        key, has, value = raw.strip().removeprefix("export ").partition("=")
        key = key.strip()
        if has and not raw.strip().startswith("#") and re.fullmatch("[A-Z_][A-Z0-9_]*", key) and key not in into:
            into[key] = value.strip().strip('"').strip("'")
            named.append(key)
    return named
