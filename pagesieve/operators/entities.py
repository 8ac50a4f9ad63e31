"""Records of persons: from decisions to records, merged per person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import lexicons as lx, text as tx
from ..sources.shared import stored

PROFILE_KINDS = list(lx.PROFILE_HOSTS)
#: Numbers between two visits: more than persons on any page.
SEQ = 1_000_000
#: What a record keeps of the run that made it.
RUN = ["llm_provider", "llm_model", "last_checked_utc", "run_id"]


def records(kept: DataFrame) -> DataFrame:
    """One record per selected person of a kept decision (university, visit, url, section, profile_links map, d).

    People with the role supervisor or contact, or all if none has; the section stands in for a missing department; profile
    links only where one person is selected.
    """
    role = lambda p: F.coalesce(F.nullif(p["role"], F.lit("")), F.lit("supervisor")).isin("supervisor", "contact")
    people = F.filter("d.people", role)
    people = F.when(F.size(people) > 0, people).otherwise(F.col("d.people"))
    rows = kept.withColumn("_people", people).select("*", F.posexplode("_people").alias("_k", "_p"))
    links = lambda kind: F.when(F.size("_people") == 1, F.coalesce(F.try_element_at("profile_links", F.lit(kind)), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    text = lambda c: F.coalesce(c, F.lit(""))
    wrapped = lambda c: F.when(text(c) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "university",
        (F.col("visit") * SEQ + F.col("_k")).cast("bigint").alias("seq"),
        F.col("_p.name").alias("name"),
        text(F.col("_p.title")).alias("title_role"),
        F.coalesce(F.nullif(F.col("_p.department"), F.lit("")), F.col("section"), F.lit("")).alias("department"),
        F.coalesce("_p.research_interests", F.array().cast("array<string>")).alias("research_interests"),
        F.col("d.degree_levels").alias("degree_levels"),
        text(F.col("d.position_title")).alias("position_title"),
        F.col("d.funding_status").alias("funding_status"),
        text(F.col("d.funding_source")).alias("funding_source"),
        text(F.col("d.deadline")).alias("deadline"),
        text(F.col("d.start_date")).alias("start_date"),
        text(F.col("_p.email")).alias("email"),
        *(links(k).alias(k) for k in PROFILE_KINDS),
        F.col("d.field_score").alias("field_match_score"),
        F.col("d.funding_confidence").alias("funding_confidence"),
        F.col("d.matched_topics").alias("matched_topics"),
        F.coalesce("d.rationale", F.lit("")).alias("rationale"),
        wrapped(F.col("d.funding_quote")).alias("funding_evidence"),
        wrapped(F.col("d.position_quote")).alias("position_evidence"),
        F.array("url").alias("source_urls"),
        *((F.coalesce(F.col(c), F.lit("")) if c in kept.columns else F.lit("")).alias(c) for c in RUN),
    )


def with_entity(rows: DataFrame) -> DataFrame:
    """rows (university, seq, name, email) with entity, the seq of the record that opened it.

    The key is the lower-case address, else the name key. A record without address joins the earliest entity whose opening
    name key is equal, wherever it comes from; records with an address stay with their address.
    """
    keyed = rows.withColumns({"_e": F.nullif(F.lower(F.trim(F.coalesce("email", F.lit("")))), F.lit("")), "_k": tx.name_key(F.col("name"))})
    mail = keyed.where("_e is not null").groupBy("university", "_e").agg(F.min("seq").alias("mail_first"), F.min_by("_k", "seq").alias("_k"))
    names = keyed.where("_e is null").groupBy("university", "_k").agg(F.min("seq").alias("first"))
    anchors = mail.select("university", "_k", F.col("mail_first").alias("first")).unionByName(names).groupBy("university", "_k").agg(F.min("first").alias("name_first"))
    out = keyed.join(mail.drop("_k"), ["university", "_e"], "left").join(anchors, ["university", "_k"], "left")
    return out.withColumn("entity", F.when(F.col("_e").isNotNull(), F.col("mail_first")).otherwise(F.col("name_first"))).drop("_e", "_k", "mail_first", "name_first")


def merged(rows: DataFrame) -> DataFrame:
    """One record per entity, in the order of seq: first non-empty attributes, best funding, greatest scores, ordered unions.

    What is neither comes from the first record. Lists meet value by value, each distinct value once, so that a person
    named on any number of pages is no more than the values these pages hold.
    """
    names = [c for c in rows.columns if c not in ("university", "seq")]
    by = ["university", "entity"]
    held = stored(with_entity(rows), "entities")
    lists = [c for c in names if c in lx.UNIONS]
    rank = F.create_map(*(F.lit(x) for kv in lx.FUNDING_RANK.items() for x in kv))
    out = {}
    for c in names:
        v = F.col(c)
        if c in lx.FIRST_FILLED:
            out[c] = F.coalesce(F.min_by(v, F.when(F.coalesce(v, F.lit("")) != "", F.col("seq"))), F.lit(""))
        elif c == "funding_status":
            out[c] = F.max_by(v, F.struct(F.coalesce(F.try_element_at(rank, v), F.lit(-1)), -F.col("seq")))
        elif c in ("field_match_score", "funding_confidence"):
            out[c] = F.max(v)
        else:
            out[c] = F.min_by(v, "seq")
    one = held.groupBy(*by).agg(F.count("*").alias("_n"), *(v.alias(c) for c, v in out.items()))
    if not lists and "rationale" not in names:
        return one.select("university", F.col("entity").alias("seq"), *names)
    # list, value, place of its first occurrence
    placed = lambda c: F.transform(F.coalesce(F.col(c), _nothing()), lambda v, i: F.struct(F.lit(c).alias("list"), v.alias("value"), i.alias("i")))
    items = [placed(c) for c in lists]
    if "rationale" in names:
        items.append(F.array(F.struct(F.lit("rationale").alias("list"), F.col("rationale").alias("value"), F.lit(0).alias("i"))))
    each = held.select(*by, "seq", F.explode(F.concat(*items)).alias("x")).where("x.value <> ''")
    first = each.groupBy(*by, "x.list", "x.value").agg(F.min(F.struct("seq", "x.i")).alias("at"))
    lined = first.groupBy(*by, "list").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))
    unions = lined.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("list", "values"))).alias("_u"))
    values = lambda c: F.coalesce(F.try_element_at("_u", F.lit(c)), _nothing())

    def column(c: str) -> Column:
        if c in lists:
            own = F.coalesce(F.col(c), _nothing())
            return F.concat(own, F.array_except(values(c), own))
        if c == "rationale":
            joined = F.aggregate(values(c), F.lit(""), lambda a, v: F.when(F.contains(a, v), a).when(a == "", v).otherwise(F.concat(a, F.lit(" / "), v)))
            return F.when(F.col("_n") > 1, joined).otherwise(F.coalesce(c, F.lit("")))
        return F.col(c)

    return one.join(unions, by, "left").select("university", F.col("entity").alias("seq"), *(column(c).alias(c) for c in names))


def _nothing() -> Column:
    return F.array().cast("array<string>")


def ranked(records_: DataFrame) -> DataFrame:
    """Order of the report: field score and confidence from the top, then name."""
    return records_.orderBy(F.desc("field_match_score"), F.desc("funding_confidence"), "name")


def numbered(records_: DataFrame) -> DataFrame:
    by = W.partitionBy("university").orderBy(F.desc("field_match_score"), F.desc("funding_confidence"), "name")
    return records_.withColumn("rank", F.row_number().over(by))
