"""Funnel, health and outcome reports: conditional aggregation, rates and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def funnel(rows: DataFrame, stage: str, entity: str, passed: Column, low: tuple[float, float], high_rate: Column | None = None, high: tuple[float, float] = (0.5, 0.8)) -> DataFrame:
    """Per stage: rows, entities, passed, the pass rate and its flag, and the worst flag with a second, high-is-bad rate."""
    out = rows.groupBy(stage).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(entity).alias("n_entities"),
        F.count_if(passed).alias("n_passed"),
        F.count_if(high_rate if high_rate is not None else F.lit(False)).alias("n_bad"),
    )
    out = out.withColumn("pass_rate", stats.rate(F.col("n_passed"), F.col("n"))).withColumn("bad_rate", stats.rate(F.col("n_bad"), F.col("n")))
    out = out.withColumn("pass_flag", stats.flag_low(F.col("pass_rate"), *low)).withColumn("bad_flag", stats.flag_high(F.col("bad_rate"), *high))
    return out.withColumn("flag", stats.worst(F.col("pass_flag"), F.col("bad_flag")))


def reason_counts(ledger: DataFrame) -> DataFrame:
    """(stage, reason, n); rows with a blank stage or reason are skipped."""
    kept = ledger.where((F.coalesce("stage", F.lit("")) != "") & (F.coalesce("reason", F.lit("")) != ""))
    return kept.groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"))


def top_reasons(ledger: DataFrame, n: int = 15) -> DataFrame:
    return reason_counts(ledger).orderBy(F.desc("n"), "stage", "reason").limit(n)


def by_language(rows: DataFrame, languages: str, aggregates: dict[str, Column], total: str = "__total__") -> DataFrame:
    """The aggregates for each language a row counts under, and once over all rows."""
    named = [c.alias(n) for n, c in aggregates.items()]
    each = rows.withColumn("language", F.explode(F.array_distinct(F.col(languages)))).groupBy("language").agg(*named)
    return each.unionByName(rows.agg(*named).withColumn("language", F.lit(total)))


def status_counts(rows: DataFrame, status: str, known: list[str]) -> DataFrame:
    """(status, n) for every known status, also those without rows."""
    counts = rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame([(k,) for k in known], f"`{status}` string")
    return every.join(counts, status, "left").fillna(0, ["n"])


def outcomes(entities: DataFrame, facts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per entity: a count from each fact table and a final status by the first stage without rows.

    ``facts`` are in funnel order; the status is no_<first empty fact>, or 'complete'.
    """
    out = entities.select(key)
    status = F.lit("complete")
    for name, fact in facts.items():
        counts = fact.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(counts, key, "left").fillna(0, [f"n_{name}"])
    for name in reversed(list(facts)):
        status = F.when(F.col(f"n_{name}") == 0, f"no_{name}").otherwise(status)
    return out.withColumn("final_status", status)


def shadow_recall(decisions: DataFrame, languages: str) -> DataFrame:
    """Per language and in all: decided, passed, kept by the later stage, and the share of the kept that had passed."""
    return by_language(
        decisions,
        languages,
        {
            "n": F.count(F.lit(1)),
            "n_pass": F.count_if(F.col("decision") == "pass"),
            "n_kept": F.count_if(F.col("kept")),
            "shadow_recall": stats.rate(F.count_if(F.col("kept") & (F.col("decision") == "pass")), F.count_if(F.col("kept"))),
        },
    )


def readiness(breakdown: DataFrame, reference: str, gap: float, bar: float) -> DataFrame:
    """(language, ready): the rate is at most ``gap`` below the reference language's and at least ``bar``; breakdown(language, rate)."""
    at = breakdown.where(F.col("language") == reference).select(F.col("rate").alias("wanted"))
    wanted = at.first()
    least = None if wanted is None else wanted["wanted"]
    return breakdown.select("language", "rate", (F.coalesce(F.col("rate") >= F.lit(least) - gap, F.lit(False)) & F.coalesce(F.col("rate") >= bar, F.lit(False))).alias("ready"))
