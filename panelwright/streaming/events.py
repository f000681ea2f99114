"""Run state, running totals, ledgers and breakers over an append-only event log.

Event: run_id, seq, ts, event, stage, host, units. The folds are written on
plain DataFrames, so they serve a batch replay and, where the plan allows it,
a stream; ``*_stream`` functions are the stateful streaming forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "stopped", "failed")


def run_status(events: DataFrame) -> DataFrame:
    """(run_id, status, stage_in_flight): the last terminal event unless a later 'resumed'; else 'running'.

    The stage in flight is the last one started and not completed after that.
    """
    last = F.max(F.when(F.col("event").isin(*TERMINAL), F.struct("seq", "event")))
    resumed = F.max(F.when(F.col("event") == "resumed", F.col("seq")))
    runs = events.groupBy("run_id").agg(last.alias("last"), resumed.alias("resumed"))
    stages = events.where(F.col("stage").isNotNull()).groupBy("run_id", "stage").agg(F.max(F.when(F.col("event") == "stage_started", F.col("seq"))).alias("started"), F.max(F.when(F.col("event") == "stage_completed", F.col("seq"))).alias("done"))
    flying = stages.where("started IS NOT NULL AND (done IS NULL OR done < started)").groupBy("run_id").agg(F.max_by("stage", "started").alias("stage_in_flight"))
    status = F.when(F.col("last").isNull() | (F.col("resumed") > F.col("last.seq")), "running").otherwise(F.col("last.event"))
    return runs.join(flying, "run_id", "left").select("run_id", status.alias("status"), F.when(status == "running", F.col("stage_in_flight")).alias("stage_in_flight"))


def running_spend(events: DataFrame, budget: float) -> DataFrame:
    """Each event with the running total of its stage and whether the budget is passed, in order of seq."""
    total = F.sum("units").over(Window.partitionBy("run_id", "stage").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("spent", F.round(total, 4)).withColumn("over_budget", F.round(total, 4) > budget)


def spend_totals(events: DataFrame) -> DataFrame:
    """(stage, units): running totals as a streaming aggregate (update or complete mode), or a batch one."""
    return events.groupBy("stage").agg(F.round(F.sum("units"), 4).alias("units"), F.count(F.lit(1)).alias("n"))


def ledger(events: DataFrame, keys: list[str], watermark: str | None = None) -> DataFrame:
    """The first row for each key; on a stream its state is bounded by a watermark on ts where one is given."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys) if watermark else events.dropDuplicates(keys)


def host_breaker(attempts: DataFrame, threshold: int) -> DataFrame:
    """Each attempt (host, seq, ok) with the failures since the host's last success and whether the breaker is open; once open it stays so."""
    order = Window.partitionBy("host").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(order)
    run = Window.partitionBy("host", "island_").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    failures = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(run)
    counted = attempts.withColumn("island_", island).withColumn("failures", failures)
    return counted.withColumn("is_open", F.max(F.col("failures") >= threshold).over(order)).drop("island_")


def host_breaker_stream(attempts: DataFrame, threshold: int) -> DataFrame:
    """(host, failures, is_open) after each micro-batch: a counter and a flag of state per host."""

    def fold(key, frames: Iterator[pd.DataFrame], state):
        failures, is_open = state.get if state.exists else (0, False)
        for row in pd.concat(frames).sort_values("seq").itertuples():
            failures = 0 if row.ok else failures + 1
            is_open = is_open or failures >= threshold
        state.update((failures, is_open))
        yield pd.DataFrame({"host": [key[0]], "failures": [failures], "is_open": [is_open]})

    return attempts.groupBy("host").applyInPandasWithState(fold, "host string, failures long, is_open boolean", "failures long, is_open boolean", "update", "NoTimeout")


def throttle_violations(requests: DataFrame, gap_s: float) -> DataFrame:
    """(host, seq, gap): requests that follow the host's previous one by less than the gap; ts in seconds."""
    before = F.lag("at").over(Window.partitionBy("host").orderBy("at", "seq"))
    return requests.withColumn("gap", F.round(F.col("at") - before, 6)).where(F.col("gap") < gap_s).select("host", "seq", "gap")
