"""Source fields: routing, credibility, confidence, dates; and bounded link following."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

# Fixed values of the vocabulary.
MISSING_DATES = ("unknown", "not_documented")
DOWNGRADES = ("downgraded_no_quote", "downgraded_quote_not_stating_value", "downgraded_low_confidence")


def route_source_type(official: Column, archived: Column) -> Column:
    """official_domain, archive_address, or null where the question must be asked."""
    return F.when(official.isin("own_official", "other_official"), "official_domain").when(archived, "archive_address")


def discovery_path(followed: Column, hop: Column, backfill: Column) -> Column:
    """searched, followed_hop_n or backfill_followed; null where the provenance is missing or has no code."""
    return F.when(~followed & ~backfill, "searched").when(followed & backfill, "backfill_followed").when(followed & (hop >= 1), F.concat(F.lit("followed_hop_"), hop.cast("string")))


def source_credibility(source_type: Column, published: Column, cells: dict[str, str]) -> Column:
    """'low' without a publication date, else the type's cell; null for a type without one."""
    table = F.create_map(*[F.lit(x) for pair in cells.items() for x in pair])
    return F.when(published.isin(*MISSING_DATES), "low").otherwise(table[source_type])


def source_confidence(checks: DataFrame, credibility: DataFrame, source: str) -> DataFrame:
    """(source, confidence): low if any check failed, else unfinished if any is pending, else the credibility or unknown; checks(source, status, second_reason), a null status is pending."""
    failed = F.coalesce(F.col("status").isin(*DOWNGRADES), F.lit(False)) | F.coalesce(F.col("second_reason").isin(*DOWNGRADES), F.lit(False))
    seen = checks.groupBy(source).agg(F.bool_or(failed).alias("failed"), F.bool_or(F.col("status").isNull()).alias("pending"))
    value = F.when(F.col("failed"), "low").when(F.col("pending"), "unfinished").otherwise(F.coalesce("credibility", F.lit("unknown")))
    return seen.join(credibility.select(source, "credibility"), source, "left").select(source, value.alias("confidence"))


def vendor_claim_only(types: DataFrame, activity: str) -> DataFrame:
    """(activity, value): yes if every supporting source is a vendor's; unknown if any type is missing."""
    return types.groupBy(activity).agg(F.when(F.bool_or(F.col("type").isNull()), "unknown").when(F.bool_and(F.col("type") == "vendor"), "yes").otherwise("no").alias("value"))


def publication_date(metadata: Column, quote_checked: Column) -> Column:
    return F.coalesce(metadata, quote_checked, F.lit("not_documented"))


def deterministic_date(candidates: DataFrame, page: str) -> DataFrame:
    """(page, value, consistent): of dated tags (page, tag_rank, value) the best rank's most precise value, and whether all of that rank agree as prefixes."""
    best = candidates.withColumn("best_", F.min("tag_rank").over(Window.partitionBy(page))).where("tag_rank = best_")
    longest = best.groupBy(page).agg(F.max_by("value", F.struct(F.length("value"), "value")).alias("chosen"), F.collect_set("value").alias("all"))
    return longest.select(page, F.col("chosen").alias("value"), F.forall("all", lambda v: F.col("chosen").startswith(v)).alias("consistent"))


def latest_observation(dated: DataFrame, unit: str) -> DataFrame:
    """(unit, value, ambiguous) of partial dates: the period that ends last; ambiguous if another period of the unit reaches into it without being equal."""
    from ..functions import dates

    rows = dated.select(unit, "value", dates.first_day(F.col("value")).alias("first"), dates.last_day(F.col("value")).alias("last")).where("first IS NOT NULL").distinct()
    top = rows.groupBy(unit).agg(F.max_by(F.struct("value", "first"), F.struct("first", F.negative(F.length("value")))).alias("t"))
    met = rows.join(top, unit)
    overlap = (F.col("value") != F.col("t.value")) & (F.col("last") >= F.col("t.first"))
    return met.groupBy(unit).agg(F.any_value("t.value").alias("value"), F.bool_or(overlap).alias("ambiguous"))


def follow(starts: DataFrame, links: DataFrame, hops: int = 3, cap: int = 10) -> DataFrame:
    """(institution, url, hop): breadth-first link following, nearest first, each URL once, at most ``cap`` followed per institution.

    starts(institution, url) have hop 0 and do not count; links(url, to, nearness).
    """
    seen = cut(starts.select("institution", "url").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in range(1, hops + 1):
        found = front.join(links, "url").groupBy("institution", F.col("to").alias("url")).agg(F.min("nearness").alias("near"))
        fresh = found.join(seen.select("institution", "url"), ["institution", "url"], "left_anti")
        used = seen.groupBy("institution").agg(F.count_if(F.col("hop") > 0).alias("used"))
        nth = F.row_number().over(Window.partitionBy("institution").orderBy("near", "url"))
        front = cut(fresh.withColumn("nth", nth).join(used, "institution").where(F.col("nth") + F.col("used") <= cap).select("institution", "url", F.lit(hop).alias("hop")))
        seen = cut(seen.unionByName(front))
    return seen


def origins(derived: DataFrame, depth: int | None = None) -> DataFrame:
    """(record, origin, cyclic): what each record finally derives from (derived(record, source)), however deep; ``depth`` is kept for callers and limits nothing.

    A record of a cycle is its own origin and cyclic; one whose chain runs into
    a cycle is cyclic with the place where it enters as origin. Reach doubles in each round until it grows no more.
    """
    up = cut(derived.where("source IS NOT NULL").select("record", F.col("source").alias("at")).distinct())
    reached, n, before = up, up.count(), -1
    while n != before:
        further = reached.join(reached.select(F.col("record").alias("at"), F.col("at").alias("to")), "at").select("record", F.col("to").alias("at"))
        reached = cut(reached.union(further).distinct())
        before, n = n, reached.count()
    ends = reached.join(up.select(F.col("record").alias("at")).distinct(), "at", "left_anti").select("record", F.col("at").alias("origin"), F.lit(False).alias("cyclic"))
    nothing = derived.where("source IS NULL").select("record", F.col("source").alias("origin"), F.lit(False).alias("cyclic"))
    on_cycle = reached.where("record = at").select("record")
    own = on_cycle.select("record", F.col("record").alias("origin"), F.lit(True).alias("cyclic"))
    # Steps into a cycle that do not come back, and all that reach them.
    entries = up.join(on_cycle.select(F.col("record").alias("at")), "at", "left_semi").select("record", "at")
    entries = entries.join(reached.select(F.col("at").alias("record"), F.col("record").alias("at")), ["record", "at"], "left_anti")
    later = reached.join(entries.select(F.col("record").alias("at"), F.col("at").alias("origin")), "at").select("record", "origin")
    into = entries.select("record", F.col("at").alias("origin")).union(later).select("record", "origin", F.lit(True).alias("cyclic"))
    return ends.union(nothing).union(own).union(into).distinct()
