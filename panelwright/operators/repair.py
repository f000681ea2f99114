"""Contract checks as violation rows, and deterministic repair of coded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NA = "_NA_"
# What a field takes on a confirming row where it could not be determined.
DEFAULTS = {
    "adoption_stage": "unknown",
    "access_type": "unknown",
    "interaction_type": "unknown",
    "tool_name": "unknown",
    "vendor": "unknown",
    "deployment_mode": "unknown",
    "target_users": "unknown",
    "year_announced": "unknown",
    "year_deployed": "unknown",
    "has_human_oversight": "not_documented",
    "has_transparency_notice": "not_documented",
    "has_data_classification": "not_documented",
    "has_risk_assessment": "not_documented",
    "reported_outcomes": "none_reported",
    "reported_incidents": "none_reported",
    "scope_notes": "none",
}
# Fields without a default, and fields that assert an activity.
WITHOUT_DEFAULT = ("activity_type", "activity_name")
ASSERTING = ("activity_name", "activity_type", "tool_name", "vendor")


def _named(columns: list[str], test) -> Column:
    return F.array_compact(F.array(*[F.when(test(F.col(c)), F.lit(c)) for c in columns]))


def salvage_missing(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Fill '_NA_' of confirming rows by default; a row that needs a field without default is left as it is.

    Adds salvaged_fields and unsalvageable_fields (arrays, empty where nothing applies).
    """
    confirming = F.col("genai_evidence") == "confirms_activity"
    missing = _named(fields, lambda c: c == NA)
    stuck = F.filter(missing, lambda f: f.isin(*WITHOUT_DEFAULT))
    none = F.array().cast("array<string>")
    marked = rows.withColumn("stuck_", F.when(confirming, stuck).otherwise(none)).withColumn("filled_", F.when(confirming & (F.size(stuck) == 0), missing).otherwise(none))
    fixed = {f: F.when(F.array_contains("filled_", f), F.lit(DEFAULTS[f])).otherwise(F.col(f)) for f in fields if f in DEFAULTS}
    return marked.withColumns(fixed).withColumnsRenamed({"filled_": "salvaged_fields", "stuck_": "unsalvageable_fields"})


def salvage_negative(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Blank stray fields of rows that confirm nothing, unless one asserts an activity: such a row is left and named contradictory."""
    negative = F.col("genai_evidence").isNotNull() & (F.col("genai_evidence") != "confirms_activity")
    strays = _named(fields, lambda c: c.isNotNull() & (c != NA))
    contradictory = F.filter(strays, lambda f: f.isin(*ASSERTING))
    none = F.array().cast("array<string>")
    marked = rows.withColumn("against_", F.when(negative, contradictory).otherwise(none)).withColumn("blanked_", F.when(negative & (F.size(contradictory) == 0), strays).otherwise(none))
    fixed = {f: F.when(F.array_contains("blanked_", f), F.lit(NA)).otherwise(F.col(f)) for f in fields}
    return marked.withColumns(fixed).withColumnsRenamed({"blanked_": "blanked_fields", "against_": "contradictory_fields"})


def salvage_flags(flags: Column) -> Column:
    """White space around ';' goes; a blank or whole '_NA_' value becomes 'none'."""
    tidy = F.array_join(F.transform(F.split(flags, ";"), lambda f: F.trim(f)), ";")
    return F.when(F.trim(tidy).isin("", NA), "none").otherwise(tidy)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code): one row for each rule that a row breaks; a rule that is null holds."""
    codes = F.array_compact(F.array(*[F.when(~rule, F.lit(code)) for code, rule in rules.items()]))
    return rows.select(F.col(key).alias("key"), F.explode(codes).alias("code"))


def inconsistent(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, field): fields of which one group has several values."""
    counted = rows.groupBy(group).agg(*[F.count_distinct(f).alias(f) for f in fields])
    return counted.select(F.col(group).alias("key"), F.explode(F.array_compact(F.array(*[F.when(F.col(f) > 1, F.lit(f)) for f in fields]))).alias("field"))


def vocabulary_errors(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (key, version, value) whose value their version's vocabulary (version, value) does not hold."""
    return rows.join(vocabulary.select("version", "value"), ["version", "value"], "left_anti").select("key", "version", "value")


def unstepped_versions(lists: DataFrame) -> DataFrame:
    """(item, release): value lists that changed from one release to the next under the same label; lists(item, release, label, value_list)."""
    from pyspark.sql import Window

    before = Window.partitionBy("item").orderBy("release")
    seen = lists.withColumn("old", F.lag("value_list").over(before)).withColumn("old_label", F.lag("label").over(before))
    return seen.where((F.col("old") != F.col("value_list")) & (F.col("old_label") == F.col("label"))).select("item", "release")
