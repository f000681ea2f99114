"""Token pricing, projections and null-propagating totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiered_usd(prompt: Column, cached: Column, completion: Column, rates: dict[str, float], threshold: int = 200_000) -> Column:
    """Price of a request; a prompt beyond the threshold pays the high rates throughout. Rates are USD per million tokens."""
    high = prompt > threshold
    rate = lambda name: F.when(high, rates[f"{name}_high"]).otherwise(rates[name])
    return ((prompt - cached) * rate("input") + cached * rate("cached") + completion * rate("output")) / 1e6


def priced_totals(usage: DataFrame, prices: DataFrame, group: str) -> DataFrame:
    """(group, usd): sum over models of units times price; null if a model of the group has no price."""
    met = usage.join(prices, "model", "left")
    return met.groupBy(group).agg(F.when(F.count_if(F.col("price").isNull()) > 0, None).otherwise(F.round(F.sum(F.col("units") * F.col("price")), 4)).alias("usd"))


def project_modes(per_unit: Column, n: int, modes: dict[str, float]) -> Column:
    """map<mode, usd>: the cost of n units under each mode's multiplier."""
    return F.create_map(*[x for mode, factor in modes.items() for x in (F.lit(mode), F.round(per_unit * n * factor, 2))])


def within_projection(spent: Column, estimate_so_far: Column, remaining: Column, budget: float, stages: Column, safety: float = 1.25) -> Column:
    """Whether what was spent and the scaled rest stay within budget * safety; the ratio is clamped to 0.5 to 3; below two stages always true."""
    ratio = F.least(F.greatest(F.coalesce(F.try_divide(spent, estimate_so_far), F.lit(1.0)), F.lit(0.5)), F.lit(3.0))
    return (stages < 2) | (spent + ratio * remaining <= budget * safety)


def timing_summary(windows: DataFrame) -> DataFrame:
    """(stage, work_s, wall_s, n): work summed over distinct windows (shared chunks count once), wall from first start to last end; windows(stage, chunk, start, end) in seconds."""
    distinct = windows.select("stage", "chunk", "start", "end").distinct()
    return distinct.groupBy("stage").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("work_s"), F.round(F.max("end") - F.min("start"), 3).alias("wall_s"), F.count(F.lit(1)).alias("n"))
