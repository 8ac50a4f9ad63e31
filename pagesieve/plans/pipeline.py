"""evaluate(): pages to kept records, rejections and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicons as lx, text as tx, urls
from ..operators import classify as cl, decisions as dc, entities as en, html
from ..sources.shared import stored

SHOWN_TITLE, SHOWN_SUMMARY = 200, 300


def analysed(pages: DataFrame, profile: dc.Profile, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """Parsed pages with canonical URL, emails, signals, profile links and kind. terms may replace the position, funding and negative lexicons."""
    terms = terms or {}
    p = html.parsed(pages)
    p = p.withColumns({"canonical": F.coalesce(urls.canonical(F.col("url")), F.col("url")), "emails": html.emails(p), "found": html.targets(F.col("links"))})
    p = p.withColumn("signals", tx.signals(F.concat_ws("\n", "title", "text"), profile.terms(), terms.get("position"), terms.get("funding"), terms.get("negative")))
    p = stored(p.drop("links", "raw_text", "mailto", "protected"), "pages-analysed")
    p = p.withColumns({"profile_links": html.profile_links(F.col("found")), "n_people": html.n_people(html.followable(F.col("found")))})
    kind = html.page_kind(F.col("canonical"), F.col("title"), F.col("headings"), F.size("signals.position") > 0, F.size("emails"), F.col("n_people"), F.size("profile_links") > 0)
    return p.withColumn("kind", kind)


def prefiltered(analysed_pages: DataFrame, mode: str = "loose", least: int = 200) -> DataFrame:
    has = lambda c: F.size(f"signals.{c}") > 0
    reason = tx.prefilter_reason(F.length("text"), F.col("kind"), has("position"), has("funding"), has("negative"), has("fields"), mode, least)
    return analysed_pages.withColumn("prefilter", reason).withColumn("accepted", F.col("prefilter").isin(tx.ACCEPTED))


def evaluate(
    pages: DataFrame,
    profile: dc.Profile,
    *,
    today: str,
    university: str = "all",
    mode: str = "loose",
    least: int = 200,
    terms: dict[str, list[str]] | None = None,
    scorer: cl.Scorer | None = None,
    cache: DataFrame | None = None,
    budget: int = 1 << 40,
    run_id: str = "",
    checked_utc: str = "",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, rejections, statistics) of pages (page_id, url, html; university, visit and section where present).

    Without a scorer the deterministic one decides. Rejections hold what the scorer or the rules dropped, and what the
    prefilter dropped although it showed a position or funding signal.
    """
    terms = terms or {}
    if scorer is None:
        raw = [*profile.target_fields, *profile.keywords]
        scorer = cl.SentenceScorer(fields=raw, **{k: v for k, v in terms.items() if k in ("position", "funding", "negative")})
    given = {"university": F.lit(university), "visit": F.col("page_id"), "section": F.lit("")}
    pages = pages.withColumns({c: v for c, v in given.items() if c not in pages.columns})
    seen = stored(prefiltered(analysed(pages, profile, terms), mode, least), "pages-seen")
    passed = seen.where("accepted").select("university", "visit", "section", F.col("canonical").alias("url"), "kind", "title", "text", "emails", "profile_links", "signals")
    judged = cl.classified(passed, profile, scorer, today=today, cache=cache, budget=budget)
    run = {"llm_provider": scorer.name, "llm_model": scorer.model, "last_checked_utc": checked_utc, "run_id": run_id}
    kept = judged.where("keep").withColumns({c: F.lit(v) for c, v in run.items()})
    records = en.merged(en.records(kept))
    signalled = (F.size("signals.position") > 0) | (F.size("signals.funding") > 0)
    nothing = F.lit(None)
    early = seen.where(~F.col("accepted") & signalled).select(
        "university",
        F.col("canonical").alias("url"),
        F.col("kind").alias("page_kind"),
        F.lit("prefilter").alias("stage"),
        F.array("prefilter").alias("reasons"),
        F.left("title", F.lit(SHOWN_TITLE)).alias("summary"),
        nothing.cast("double").alias("field_match_score"),
        nothing.cast("string").alias("funding_status"),
    )
    late = judged.where("not keep").select(
        "university",
        "url",
        F.col("kind").alias("page_kind"),
        F.when(F.col("d").isNull(), "llm").otherwise("rules").alias("stage"),
        "reasons",
        F.left(F.coalesce("d.summary", "error", F.lit("")), F.lit(SHOWN_SUMMARY)).alias("summary"),
        F.col("d.field_score").alias("field_match_score"),
        F.col("d.funding_status").alias("funding_status"),
    )
    stats = seen.groupBy("kind", "prefilter").agg(F.count("*").alias("pages"), F.sum(F.col("accepted").cast("bigint")).alias("accepted"))
    return records, early.unionByName(late).select(*lx.REJECTION_COLUMNS), stats
