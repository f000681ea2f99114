"""Consolidated panels: shaping, summaries, quality counts and contract rules over three normalised tables.

institutions(inst, verdict, ...), activities(inst, pos, activity_id, ...) and
sources(inst, pos, source_id, activity_id, ...) are related by inst and
activity_id; ``_NA_`` links a source to no activity. Every operator is a few
grouped passes and joins on inst, so an institution's rows never have to meet
in one Python object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .rows import global_row_id

NA = "_NA_"

# Words that show a generative signal, hedged language, a firm commitment.
GENERATIVE = (
    "generative", "genai", "gen ai", "gen-ai", "gpt", "chatgpt", "copilot", "gemini", "claude", "llama", "mistral", "large language model", "llm",
    "foundation model", "albert", "codewhisperer", "text-to-image", "image generation", "code generation",
)
HEDGED = (
    "is considering", "are considering", "is exploring", "are exploring", "studying the feasibility", "may adopt", "might adopt", "may explore", "might explore",
    "in early discussions", "potential use case", "potential use cases", "eager to", "looking into", "anticipated",
)
FIRM = (
    "plans to introduce", "will deploy", "will launch", "signed a memorandum", "signed an mou", "budget of", "allocated $", "allocated €", "procurement",
    "contract award", "contract was awarded", "policy was adopted", "strategy was published", "launched in",
)
# Page verdicts that speak against an activity, and those that a "no" may rest on.
NEGATIVE = ("confirms_absence", "no_genai", "background_only", "event_only", "other_body")
PERMITTED = (*NEGATIVE, "not_assessable")


def keyword_pattern(keywords: tuple[str, ...]) -> str:
    """A regular expression for any of the keywords: not inside a word, with a plural s where it ends in a letter or digit."""
    quoted = []
    for word in sorted(keywords):
        start = r"(?<!\w)" if word[0].isalnum() else ""
        end = r"s?(?!\w)" if word[-1].isalnum() else ""
        quoted.append(start + "".join(c if c.isalnum() else "\\" + c for c in word) + end)
    return "(?U)" + "|".join(quoted)


def holds(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether the text, lower-cased and with single spaces, holds any of the keywords."""
    return F.regexp_replace(F.lower(text), f"{T.SPACE}+", " ").rlike(keyword_pattern(keywords))


def salvaged_fields(ledger: DataFrame) -> DataFrame:
    """(inst, url, fields): of each source the fields named by the last salvage entry that names any, sorted, joined by ';'."""
    named = ledger.where((F.col("reason") == "salvaged") & F.col("detail").contains(";fields=") & (F.coalesce("url", F.lit("")) != ""))
    fields = F.array_sort(F.filter(F.split(F.substring_index("detail", ";fields=", -1), ","), lambda f: f != ""))
    return named.groupBy("inst", "url").agg(F.max_by(F.array_join(fields, ";"), "seq").alias("fields"))


def source_rows(sources: DataFrame, salvaged: DataFrame, run_id: str) -> DataFrame:
    """The sources with their global row id and the fields that were salvaged for their URL ('' where none)."""
    met = sources.join(salvaged.withColumnRenamed("fields", "salvaged_fields"), ["inst", "url"], "left")
    return met.select(global_row_id(F.lit(run_id), F.col("inst").cast("string"), F.col("source_id")).alias("global_row_id"), *sources.columns, F.coalesce("salvaged_fields", F.lit("")).alias("salvaged_fields"))


def _ordered(value: str, keep: Column | None = None) -> Column:
    """The values of a group in order of pos."""
    pair = F.struct("pos", value)
    return F.transform(F.array_sort(F.collect_list(F.when(keep, pair) if keep is not None else pair)), lambda s: s[value])


def _distinct_known(column: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.col(column) != "unknown", F.col(column))))


def _best_confidence() -> Column:
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    return F.when(F.max(rank) > 0, F.get(F.array(*map(F.lit, (NA, "low", "medium", "high"))), F.max(rank))).otherwise(NA)


def summary_rows(institutions: DataFrame, activities: DataFrame, sources: DataFrame, run_id: str) -> DataFrame:
    """One row per institution: counts, names in order, distinct tools and vendors, best confidence, union of flags."""
    own = activities.groupBy("inst").agg(
        F.count(F.lit(1)).alias("n_activities"),
        F.array_join(_ordered("activity_name"), " | ").alias("activities_found"),
        F.array_join(_distinct_known("tool"), " | ").alias("tools_found"),
        F.array_join(_distinct_known("vendor"), " | ").alias("vendors_found"),
        _best_confidence().alias("best_confidence"),
        T.flags_union(F.collect_set("flags")).alias("flags"),
    )
    counted = sources.groupBy("inst").agg(F.count(F.lit(1)).alias("n_sources"), *[F.count_if(F.col("credibility") == c).alias(f"n_{c}") for c in ("high", "medium", "low")])
    met = institutions.join(own, "inst", "left").join(counted, "inst", "left")
    numbers = ("n_activities", "n_sources", "n_high", "n_medium", "n_low")
    texts = {"activities_found": "", "tools_found": "", "vendors_found": "", "best_confidence": NA, "flags": "none"}
    return met.select(
        global_row_id(F.lit(run_id), F.col("inst").cast("string"), F.lit("summary")).alias("global_row_id"), *institutions.columns,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], *[F.coalesce(c, F.lit(v)).alias(c) for c, v in texts.items()],
    )


def count_map(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): how often each value occurs, as an array of (value, n) sorted by value."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("value"), "n"))).alias(name))


def activity_signals(activities: DataFrame, sources: DataFrame) -> DataFrame:
    """(inst, activity_id, weak_signal, speculative) by the snippets of an activity's confirming sources.

    weak_signal: some snippets, none with a generative word. speculative: an
    announced activity with snippets that all hedge and none that commits.
    """
    said = sources.where((F.col("evidence") == "confirms_activity") & (F.col("activity_id") != NA))
    shown = said.groupBy("inst", "activity_id").agg(F.bool_or(holds(F.col("snippet"), GENERATIVE)).alias("signal"), F.bool_or(holds(F.col("snippet"), FIRM)).alias("firm"), F.bool_and(holds(F.col("snippet"), HEDGED)).alias("hedged"))
    met = activities.join(shown, ["inst", "activity_id"], "left")
    weak = F.coalesce(~F.col("signal"), F.lit(False))
    speculative = F.coalesce((F.col("stage") == "announced") & ~F.col("firm") & F.col("hedged"), F.lit(False))
    return met.select("inst", "activity_id", "pos", weak.alias("weak_signal"), speculative.alias("speculative"))


def qc_institutions(institutions: DataFrame, activities: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per institution: counts of activities and sources, by credibility, type and evidence, and the flagged activities."""
    signals = activity_signals(activities, sources).select("inst", "activity_id", "weak_signal", "speculative")
    joined = activities.join(signals, ["inst", "activity_id"])
    flagged = F.coalesce("flags", F.lit("none")) != "none"
    own = joined.groupBy("inst").agg(
        F.count(F.lit(1)).alias("n_activities"),
        _ordered("activity_id", flagged).alias("with_flags"),
        _ordered("activity_id", F.col("confidence") == "high").alias("high_confidence"),
        _ordered("activity_id", F.col("weak_signal")).alias("weak_signal"),
        _ordered("activity_id", F.col("speculative")).alias("speculative"),
    )
    out = institutions.select("inst", "verdict").join(own, "inst", "left").join(sources.groupBy("inst").agg(F.count(F.lit(1)).alias("n_sources")), "inst", "left")
    for column in ("credibility", "source_type", "evidence"):
        out = out.join(count_map(sources, ["inst"], column, f"by_{column}"), "inst", "left")
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(c, empty).alias(c) for c in ("with_flags", "high_confidence", "weak_signal", "speculative")]
    return out.select("inst", "verdict", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_activities", "n_sources")], *lists, "by_credibility", "by_source_type", "by_evidence")


def qc_run(per_institution: DataFrame) -> DataFrame:
    """One row: the roll-up of qc_institutions."""
    return per_institution.agg(
        F.count(F.lit(1)).alias("n_institutions"), *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("yes", "no", "unclear")],
        F.sum("n_activities").alias("n_activities"), F.sum("n_sources").alias("n_sources"),
        *[F.sum(F.size(c)).alias(f"n_{c}") for c in ("with_flags", "high_confidence", "weak_signal", "speculative")],
    )


def merged_chunks(chunks: DataFrame, activities: DataFrame, sources: DataFrame, placeholders: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One institution's chunk responses as one: (institutions, activities, sources).

    chunks(inst, chunk, verdict, summary, n_rows), activities and sources with
    a chunk column. Activities of one name become the first of them: of each
    field in ``placeholders`` the first value that is none, the highest
    confidence, the union of flags. A source that an earlier chunk has with
    the same URL, snippet and merged activity goes. The verdict is the highest
    of yes, unclear, no; the summary that of the chunk with it, then more
    rows, then the earlier one. Ids are given anew.
    """
    rank = F.when(F.col("verdict") == "yes", 2).when(F.col("verdict") == "unclear", 1).otherwise(0)
    whole = chunks.groupBy("inst").agg(F.max(rank).alias("r"), F.max_by("summary", F.struct(rank, "n_rows", -F.col("chunk"))).alias("summary"), F.count(F.lit(1)).alias("n_chunks"))
    institutions = whole.select("inst", F.get(F.array(*map(F.lit, ("no", "unclear", "yes"))), F.col("r")).alias("verdict"), "summary", "n_chunks")

    place = F.struct("chunk", "pos")
    kept = [F.coalesce(F.min_by(c, F.when(~F.col(c).isin(*none), place)), F.min_by(c, place)).alias(c) for c, none in placeholders.items()]
    named = activities.groupBy("inst", "activity_name").agg(F.min(place).alias("first"), *kept, _best_confidence().alias("confidence"), T.flags_union(F.collect_set("flags")).alias("flags"))
    order = F.array_sort(F.collect_list(F.struct("first", "activity_name", *placeholders, "confidence", "flags")))
    numbered = named.groupBy("inst").agg(order.alias("merged_")).select("inst", F.posexplode("merged_").alias("at", "one_")).select("inst", (F.col("at") + 1).alias("number"), "one_.*")

    links = activities.select("inst", "chunk", "activity_id", "activity_name").distinct().join(numbered.select("inst", "activity_name", "number"), ["inst", "activity_name"])
    linked = sources.join(links.drop("activity_name"), ["inst", "chunk", "activity_id"], "left")
    told = ("inst", "url", "snippet", "number")
    first = linked.groupBy(*told).agg(F.min("chunk").alias("first_chunk")).select(*[F.col(c).alias(f"first_{c}") for c in told], "first_chunk")
    same = F.lit(True)
    for c in told:
        same = same & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    left = linked.join(first, same).where("chunk = first_chunk").select("inst", "chunk", "pos", "url", "snippet", "number")
    ordered = left.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("chunk", "pos", "url", "snippet", "number"))).alias("kept_")).select("inst", F.posexplode("kept_").alias("at", "one_"))
    new_sources = ordered.select("inst", F.concat(F.lit("S"), F.col("at") + 1).alias("source_id"), F.coalesce(F.concat(F.lit("A"), F.col("one_.number")), F.lit(NA)).alias("activity_id"), "one_.url", "one_.snippet")
    counts = left.groupBy("inst", "number").agg(F.count(F.lit(1)).alias("n_sources"))
    new_activities = numbered.join(counts, ["inst", "number"], "left").select("inst", F.concat(F.lit("A"), F.col("number")).alias("activity_id"), "activity_name", *placeholders, "confidence", "flags", F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
    return institutions, new_activities, new_sources


def verdict_violations(institutions: DataFrame, activities: DataFrame, sources: DataFrame, version: str = "2.7") -> DataFrame:
    """(inst, rule): where the verdict does not fit the activities and the evidence.

    Version 2.5: "no" needs sources that all confirm absence, "unclear" none
    that confirms an activity. Version 2.7: a downgraded confirmation does not
    carry "yes" and may stand on "unclear"; "no" may rest on any negative
    verdict, at least one, beside pages that could not be assessed.
    """
    confirms = F.col("evidence") == "confirms_activity"
    sound = confirms & ~F.coalesce(F.col("support").startswith("downgraded_"), F.lit(False)) if version == "2.7" else confirms
    facts = sources.groupBy("inst").agg(
        F.bool_or(confirms).alias("confirmed"), F.bool_or(sound).alias("sound"), F.bool_or(F.col("evidence").isin(*NEGATIVE)).alias("negative"),
        F.bool_or(~F.col("evidence").isin(*(PERMITTED if version == "2.7" else ("confirms_absence",)))).alias("blocked"),
    )
    some = activities.select("inst").distinct().withColumn("active", F.lit(True))
    met = institutions.select("inst", "verdict").join(some, "inst", "left").join(facts, "inst", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    yes, no, unclear = (F.col("verdict") == v for v in ("yes", "no", "unclear"))
    rules = {
        "yes_without_activity": yes & ~is_("active"),
        "yes_without_confirmation": yes & ~is_("confirmed"),
        "yes_on_downgraded_only": yes & is_("confirmed") & ~is_("sound"),
        "no_with_activity": no & is_("active"),
        "no_with_other_evidence": no & is_("blocked"),
        "no_without_negative": no & ~is_("negative") & F.lit(version == "2.7"),
        "unclear_with_activity": unclear & is_("active"),
        "unclear_with_confirmation": unclear & is_("sound"),
    }
    broken = F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))
    return met.select("inst", F.explode(broken).alias("rule"))


def link_violations(activities: DataFrame, sources: DataFrame, version: str = "2.7") -> DataFrame:
    """(inst, source_id, rule): sources whose link and evidence do not fit."""
    known = activities.select("inst", "activity_id").distinct().withColumn("known", F.lit(True))
    confirms = F.col("evidence") == "confirms_activity"
    excused = F.coalesce(F.col("support").startswith("downgraded_"), F.lit(False)) & F.lit(version == "2.7")
    met = sources.join(known, ["inst", "activity_id"], "left")
    loose = F.col("activity_id") == NA
    rule = F.when(loose & confirms & ~excused, "confirmation_without_activity").when(~loose & F.col("known").isNull(), "unknown_activity").when(~loose & ~confirms, "link_without_confirmation")
    return met.select("inst", "source_id", rule.alias("rule")).where("rule IS NOT NULL")


def declared_sources(activities: DataFrame, sources: DataFrame) -> DataFrame:
    """(inst, activity_id, declared, actual): activities without a source, or with another number than they declare."""
    counted = sources.where(F.col("activity_id") != NA).groupBy("inst", "activity_id").agg(F.count(F.lit(1)).alias("actual"))
    met = activities.join(counted, ["inst", "activity_id"], "left").select("inst", "activity_id", F.col("n_sources").alias("declared"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return met.where("actual = 0 OR declared <> actual")


def field_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left_value, right_value): where two documents of one key differ, null-safe; keys of one side alone are not compared."""
    a, b = left.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields]), right.select(key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("left_value"), F.col(f"b_{f}").alias("right_value")) for f in fields])).alias("one_")
    return a.join(b, key).select(key, each).select(key, "one_.*").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def envelope_violations(institutions: DataFrame, activities: DataFrame, sources: DataFrame) -> DataFrame:
    """(inst, table, id, rule): every broken reference between the three tables, one family of anti joins."""
    known = institutions.select("inst")
    lost = lambda df, table, column: df.join(known, "inst", "left_anti").select("inst", F.lit(table).alias("table"), F.col(column).alias("id"), F.lit("unknown_institution").alias("rule"))
    twice = lambda df, table, column: df.groupBy("inst", column).count().where("count > 1").select("inst", F.lit(table).alias("table"), F.col(column).alias("id"), F.lit("repeated_id").alias("rule"))
    loose = sources.where(F.col("activity_id") != NA).join(activities.select("inst", "activity_id"), ["inst", "activity_id"], "left_anti").select("inst", F.lit("sources").alias("table"), F.col("source_id").alias("id"), F.lit("unknown_activity").alias("rule"))
    bare = activities.join(sources.select("inst", "activity_id"), ["inst", "activity_id"], "left_anti").select("inst", F.lit("activities").alias("table"), F.col("activity_id").alias("id"), F.lit("no_source").alias("rule"))
    return lost(activities, "activities", "activity_id").union(lost(sources, "sources", "source_id")).union(twice(activities, "activities", "activity_id")).union(twice(sources, "sources", "source_id")).union(loose).union(bare)


def parsed_documents(files: DataFrame, schema: str, held: DataFrame | None = None) -> DataFrame:
    """(key, status, doc) of files(key, body): loaded, unreadable (no such document), missing (null body) or held (its key is on hold)."""
    # A body that is no document parses to nulls only; _bad tells it from a document of nulls.
    doc = F.from_json("body", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    on_hold = held.select("key").distinct().withColumn("held", F.lit(True)) if held is not None else None
    rows = files.join(on_hold, "key", "left") if on_hold is not None else files.withColumn("held", F.lit(None).cast("boolean"))
    read = rows.withColumn("doc", doc)
    status = F.when(F.col("held"), "held").when(F.col("body").isNull(), "missing").when(F.col("doc").isNull() | F.col("doc._bad").isNotNull(), "unreadable").otherwise("loaded")
    return read.select("key", status.alias("status"), F.when(status == "loaded", F.col("doc").dropFields("_bad")).alias("doc"))


def review_depth(pages: DataFrame) -> DataFrame:
    """(inst, channel, n_reviewed, n_failed, n_followed, by_verdict): what was reviewed in each channel."""
    facts = pages.groupBy("inst", "channel").agg(F.count_if("reviewed").alias("n_reviewed"), F.count_if("failed").alias("n_failed"), F.count_if("followed").alias("n_followed"))
    return facts.join(count_map(pages.where("reviewed"), ["inst", "channel"], "verdict", "by_verdict"), ["inst", "channel"], "left")


def evidence_tier(action: Column, stage: Column, purchase: Column) -> Column:
    """struct(rank, tier) of an activity: documented use, commitment, governance or training only, proposal only, unclear."""
    used = action.isin("deployment", "program") & stage.isin("pilot", "production", "discontinued")
    committed = (stage == "announced") | purchase.isin("tender_or_rfp", "award_or_contract", "payment_or_subscription")
    tier = lambda rank, name: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("tier"))
    return F.when(used, tier(4, "documented_use")).when(committed, tier(3, "documented_commitment")).when(action.isin("governance", "staff_training"), tier(2, "governance_or_training_only")).when(stage == "proposed", tier(1, "proposal_only")).otherwise(tier(0, "unclear"))


def institution_verdicts(pages: DataFrame, activities: DataFrame) -> DataFrame:
    """(inst, verdict, tier): yes with a supported activity; no if a negative page was reviewed and every page is clear; else unclear.

    pages(inst, reviewed, failed, verdict, support): a page is clear if it was
    reviewed without failing and is negative with its support passed, or not
    assessable by rule. The tier is the highest of the activities'.
    """
    negative = F.col("verdict").isin(*NEGATIVE)
    clear = F.col("reviewed") & ~F.col("failed") & ((negative & (F.col("support") == "supported")) | ((F.col("verdict") == "not_assessable") & (F.col("support") == "set_by_rule")))
    facts = pages.groupBy("inst").agg(F.bool_and(F.coalesce(clear, F.lit(False))).alias("clear"), F.bool_or(F.col("reviewed") & negative).alias("negative"))
    best = activities.groupBy("inst").agg(F.max(evidence_tier(F.col("action"), F.col("stage"), F.col("purchase"))).alias("best"))
    met = facts.join(best, "inst", "full")
    verdict = F.when(F.col("best").isNotNull(), "yes").when(F.col("clear") & F.col("negative"), "no").otherwise("unclear")
    return met.select("inst", verdict.alias("verdict"), F.coalesce(F.col("best.tier"), F.when(verdict == "no", "none_found").otherwise("unclear")).alias("tier"))


def three_valued_or(*answers: Column) -> Column:
    """yes if any is, no if all are, else unknown."""
    yes, no = F.lit(False), F.lit(True)
    for a in answers:
        yes, no = yes | F.coalesce(a == "yes", F.lit(False)), no & F.coalesce(a == "no", F.lit(False))
    return F.when(yes, "yes").when(no, "no").otherwise("unknown")


def ambiguous(rows: DataFrame, unit: str, value: str, missing: tuple[str, ...]) -> DataFrame:
    """(unit, ambiguous): whether a unit has more than one answer that is not missing."""
    return rows.groupBy(unit).agg((F.count_distinct(F.when(~F.col(value).isin(*missing), F.col(value))) > 1).alias("ambiguous"))


def unanimous(rows: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, value, status): the value that all rows of a unit share, or that there is none or more than one."""
    met = rows.groupBy(unit).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    status = F.when(F.col("low").isNull(), "none").when(F.col("low") == F.col("high"), "unanimous").otherwise("ambiguous")
    return met.select(unit, F.when(status == "unanimous", F.col("low")).alias(value), status.alias("status"))


def ordered_distinct(rows: DataFrame, unit: str, order: str, value: str) -> DataFrame:
    """(unit, values): a unit's values in order, each at its first place."""
    first = rows.groupBy(unit, value).agg(F.min(order).alias("at"))
    return first.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda s: s[value]).alias("values"))


def renumbered(rows: DataFrame, group: str, order: str, letter: str, old: str) -> DataFrame:
    """(group, old, new): ids in order as letter1, letter2, ... gapless; the table by which links are repaired."""
    placed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, old))).alias("rows_")).select(group, F.posexplode("rows_").alias("at", "one_"))
    return placed.select(group, F.col(f"one_.{old}").alias(old), F.concat(F.lit(letter), F.col("at") + 1).alias("new"))
