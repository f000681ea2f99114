"""Rates, flags and small statistics as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

LEVELS = ("green", "warn", "fail")


def rate(part: Column, whole: Column) -> Column:
    """part / whole rounded to 4 places; null where the whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 4)


def flag_low(value: Column, warn: float, fail: float) -> Column:
    """A rate that is bad when low; both limits count as reached when met; null is 'not_run'."""
    return F.when(value.isNull(), "not_run").when(value <= fail, "fail").when(value <= warn, "warn").otherwise("green")


def flag_high(value: Column, warn: float, fail: float) -> Column:
    return F.when(value.isNull(), "not_run").when(value >= fail, "fail").when(value >= warn, "warn").otherwise("green")


def worst(*flags: Column) -> Column:
    any_of = lambda level: reduce(lambda a, b: a | b, [f == level for f in flags])
    none = reduce(lambda a, b: a & b, [f == "not_run" for f in flags])
    return F.when(any_of("fail"), "fail").when(any_of("warn"), "warn").when(none, "not_run").otherwise("green")


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of the Wilson score interval; null where n is 0."""
    p, d = k / n, 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.struct((centre - half).alias("low"), (centre + half).alias("high")))


def mcnemar_exact(gains: Column, losses: Column) -> Column:
    """Two-sided exact binomial p-value of discordant pairs; 1 where there are none.

    Each term follows from the one before (C(n, i) from C(n, i - 1)), as
    logarithms, so the fold has as many steps as the smaller count.
    """
    n, k = (gains + losses).cast("double"), F.least(gains, losses).cast("long")
    first = -n * F.log(F.lit(2.0))
    step = lambda acc, i: F.struct((acc["term"] + F.log((n - i + 1) / i)).alias("term"), (acc["total"] + F.exp(acc["term"] + F.log((n - i + 1) / i))).alias("total"))
    rest = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(rest, F.struct(first.alias("term"), F.exp(first).alias("total")), step)["total"]
    return F.least(F.lit(1.0), 2 * tail)


def mean_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(column, rank): the mean rank (from 1) of each distinct value, ties sharing theirs.

    Values are counted first; the distinct ones are put in ranges and summed
    from per-range totals, so no task sorts the whole table.
    """
    counts = cut(rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_")).repartitionByRange(F.col(column)).withColumn("part_", F.spark_partition_id()))
    totals = counts.groupBy("part_").agg(F.sum("n_").alias("rows_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select("part_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("offset_"))
    inside = Window.partitionBy("part_").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.col("offset_") + F.coalesce(F.sum("n_").over(inside), F.lit(0))
    return counts.join(offsets, "part_").select(column, (smaller + (F.col("n_") + 1) / 2).alias("rank"))


def kappa(both: Column, only_a: Column, only_b: Column, neither: Column) -> Column:
    """Cohen's kappa of a 2 x 2 table; null where chance agreement is 1 or the table is empty."""
    n = (both + only_a + only_b + neither).cast("double")
    seen = F.try_divide(both + neither, n)
    chance = F.try_divide((both + only_a) * (both + only_b) + (neither + only_b) * (neither + only_a), n * n)
    return F.try_divide(seen - chance, 1 - chance)
