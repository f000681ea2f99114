"""Shaping of panel rows: projections, composite keys, additive columns, privacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def institution_id(raw: Column) -> Column:
    """INST- and the master row id as seven digits, or as it stands where it is no number."""
    number = raw.try_cast("long")
    return F.when(number.isNotNull(), F.concat(F.lit("INST-"), F.lpad(number.cast("string"), F.greatest(F.lit(7), F.length(number.cast("string"))), F.lit("0")))).otherwise(F.concat(F.lit("INST-"), F.coalesce(raw, F.lit(""))))


def institution_record(master: DataFrame) -> DataFrame:
    """The eleven fields of an institution: blank optional cells are null, blank required ones empty."""
    required = {"institution_name": "institution_name", "country": "country", "branch_of_government": "branch", "level_of_government": "government_level", "institution_type": "institution_type"}
    optional = ("website", "official_site_url", "official_site_confidence", "disambiguation")
    have = lambda c: F.col(c) if c in master.columns else F.lit(None).cast("string")
    return master.select(
        institution_id(have("master_row_id")).alias("institution_id"),
        *[F.coalesce(have(source), F.lit("")).alias(name) for name, source in required.items()],
        *[F.nullif(have(c), F.lit("")).alias(c) for c in optional],
        F.coalesce(have("master_row_id"), F.lit("")).alias("master_row_id"),
    )


def global_row_id(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def tail_uid(uid: Column, pattern: str, prefix: str, digits: int = 8) -> Column:
    """The prefix and the uid's last digits; null where the uid does not have the pattern."""
    return F.when(uid.rlike(pattern), F.concat(F.lit(prefix), F.substring(uid, -digits, digits)))


def child_rows(documents: DataFrame, array: str, key: str, letter: str, run_id: str) -> DataFrame:
    """One row per element of an array, with its place as an id (A1, A2, ...) and a composite global id."""
    rows = documents.select(key, F.posexplode(array).alias("at", "item"))
    local = F.concat(F.lit(letter), (F.col("at") + 1).cast("string"))
    return rows.select(key, local.alias("local_id"), global_row_id(F.lit(run_id), F.col(key).cast("string"), local).alias("global_row_id"), "item.*")


def legacy_row(rows: DataFrame, added: dict[str, str]) -> DataFrame:
    """Null columns for what a legacy row has not, and why as JSON (field -> reason) in key order."""
    reasons = F.to_json(F.create_map(*[F.lit(x) for pair in sorted(added.items()) for x in pair]))
    return rows.select("*", *[F.lit(None).cast("string").alias(c) for c in added], reasons.alias("unavailable"))


def public_projection(rows: DataFrame, private: list[str], emails: str | None = None) -> DataFrame:
    """The rows without private columns; an email list stays as counts per domain."""
    from ..functions.text import email_domains

    out = rows.withColumn(f"{emails}_by_domain", email_domains(F.col(emails))) if emails else rows
    return out.drop(*private, *([emails] if emails else []))


def first_positive(rows: DataFrame, unit: str, rank: str, value: str, sources: str) -> DataFrame:
    """(unit, value, holders): the positive value of least rank and the sorted distinct sources that hold it; none is 'no'."""
    positive = ~F.col(value).isin("no", "unknown", "not_documented")
    best = rows.groupBy(unit).agg(F.min_by(value, F.when(positive, F.struct(rank, value))).alias("best"), F.bool_or(positive).alias("any"))
    named = best.select(unit, F.when(F.col("any"), F.col("best")).otherwise("no").alias(value))
    holders = rows.groupBy(unit, value).agg(F.array_sort(F.collect_set(sources)).alias("holders"))
    return named.join(holders, [unit, value], "left").select(unit, value, F.coalesce("holders", F.array().cast(holders.schema["holders"].dataType)).alias("holders"))
