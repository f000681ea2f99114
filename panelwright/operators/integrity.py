"""Referential integrity and alignment, as joins that return the offending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose keys no parent has."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def uncovered(parent: DataFrame, child: DataFrame, keys: list[str]) -> DataFrame:
    """Parent rows without any child."""
    return parent.join(child.select(*keys).distinct(), keys, "left_anti")


def missing_from(dimension: DataFrame, key: str, *facts: DataFrame) -> DataFrame:
    """Distinct keys of any of the facts that the dimension lacks."""
    every = facts[0].select(key)
    for more in facts[1:]:
        every = every.union(more.select(key))
    return every.distinct().join(dimension.select(key), key, "left_anti")


def count_mismatch(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, declared, actual) where the declared count differs from the rows there are; none counts 0."""
    counted = actual.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    return declared.join(counted, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where("declared <> actual").select(key, "declared", "actual")


def sequence_gaps(rows: DataFrame, group: str, number: str) -> DataFrame:
    """(group, number, expected): rows whose number is not their place (from 1) in the group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(number))
    return rows.select(group, number, place.alias("expected")).where(F.col(number) != F.col("expected"))


def keep_wins(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(url, status): full outer match of candidate URLs and decisions; on repeats a 'keep' wins.

    status: kept, dropped, missing_decision (no decision came), url_mismatch
    (a decision on no candidate).
    """
    one = decisions.groupBy("url").agg(F.max(F.when(F.col("decision") == "keep", 1).otherwise(0)).alias("keep"), F.count(F.lit(1)).alias("n_decisions"))
    both = candidates.select("url").distinct().withColumn("candidate", F.lit(True)).join(one, "url", "full")
    status = F.when(F.col("candidate").isNull(), "url_mismatch").when(F.col("keep").isNull(), "missing_decision").when(F.col("keep") == 1, "kept").otherwise("dropped")
    return both.select("url", status.alias("status"), (F.coalesce("n_decisions", F.lit(0)) > 1).alias("duplicate_url"))


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): 'missing', 'extra' or 'differs' between two keyed tables, null-safe; equal rows are left out."""
    a, b = left.select(key, F.col(value).alias("a"), F.lit(True).alias("in_a")), right.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return a.join(b, key, "full").select(key, status.alias("status")).where("status IS NOT NULL")


def asymmetric(relations: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """Relations (a, b, value) whose swapped pair says something else than the inverse."""
    table = F.create_map(*[F.lit(x) for pair in inverse.items() for x in pair])
    swapped = relations.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("value").alias("other"))
    return relations.join(swapped, ["a", "b"]).where(F.col("other") != table[F.col("value")]).select("a", "b", "value", "other")


def filled(rows: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with a blank column filled from the other table where it has a value."""
    source = other.select(key, F.col(column).alias("fill_"))
    blank = F.nullif(F.trim(F.col(column)), F.lit(""))
    return rows.join(source, key, "left").withColumn(column, F.coalesce(blank, F.col("fill_"))).drop("fill_")


def with_status(master: DataFrame, overlay: DataFrame, key: str, website: str, site: str) -> DataFrame:
    """Master left-joined to an overlay, with how the two agree: no_overlay, new, same, differs."""
    status: Column = F.when(F.col(site).isNull(), "no_overlay").when(F.coalesce(F.trim(website), F.lit("")) == "", "new").when(F.col(website) == F.col(site), "same").otherwise("differs")
    return master.join(overlay.select(key, site), key, "left").withColumn("vs_master", status)
