"""Cross-run determinism: N-way alignment of sets per institution and run.

Input: members(institution, run, member), possibly with repeats; a run in
which an institution has no member holds the empty set. Jaccard of empty sets
is 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate


def presence(members: DataFrame) -> DataFrame:
    """(institution, member, n_runs): in how many runs each member was seen."""
    return members.select("institution", "run", "member").distinct().groupBy("institution", "member").agg(F.count(F.lit(1)).alias("n_runs"))


def nway_jaccard(members: DataFrame, institutions: DataFrame, n_runs: int) -> DataFrame:
    """(institution, n_union, n_common, overlap) over all runs; 1.0 where no run has a member."""
    seen = presence(members).groupBy("institution").agg(F.count(F.lit(1)).alias("n_union"), F.count_if(F.col("n_runs") == n_runs).alias("n_common"))
    both = institutions.select("institution").distinct().join(seen, "institution", "left").fillna(0, ["n_union", "n_common"])
    return both.withColumn("overlap", F.coalesce(rate(F.col("n_common"), F.col("n_union")), F.lit(1.0)))


def mean_pairwise_jaccard(members: DataFrame, institutions: DataFrame, runs: list[str]) -> DataFrame:
    """(institution, mean_overlap): the mean over all pairs of runs; a pair of empty sets counts 1."""
    held = members.select("institution", "run", "member").distinct()
    sizes = institutions.select("institution").distinct().withColumn("run", F.explode(F.array(*map(F.lit, sorted(set(runs)))))).join(held.groupBy("institution", "run").agg(F.count(F.lit(1)).alias("n")), ["institution", "run"], "left").fillna(0, ["n"])
    a, b = sizes.alias("a"), sizes.alias("b")
    pairs = a.join(b, (F.col("a.institution") == F.col("b.institution")) & (F.col("a.run") < F.col("b.run"))).select(F.col("a.institution").alias("institution"), F.col("a.run").alias("r1"), F.col("b.run").alias("r2"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2"))
    x, y = held.alias("x"), held.alias("y")
    common = x.join(y, (F.col("x.institution") == F.col("y.institution")) & (F.col("x.member") == F.col("y.member")) & (F.col("x.run") < F.col("y.run"))).groupBy(F.col("x.institution").alias("institution"), F.col("x.run").alias("r1"), F.col("y.run").alias("r2")).agg(F.count(F.lit(1)).alias("c"))
    scored = pairs.join(common, ["institution", "r1", "r2"], "left").fillna(0, ["c"]).withColumn("j", F.coalesce(F.try_divide(F.col("c").cast("double"), (F.col("n1") + F.col("n2") - F.col("c")).cast("double")), F.lit(1.0)))
    return scored.groupBy("institution").agg(F.round(F.avg("j"), 4).alias("mean_overlap"))


def presence_histogram(members: DataFrame) -> DataFrame:
    """(n_runs, n_members): how many members exactly so many runs hold; members count per institution."""
    return presence(members).groupBy("n_runs").agg(F.count(F.lit(1)).alias("n_members"))


def flips(decisions: DataFrame, n_runs: int) -> DataFrame:
    """(institution, n_common, n_flipped, flip_rate) over members that every run decided; keep wins over drop within a run."""
    one = decisions.groupBy("institution", "run", "member").agg(F.min(F.when(F.col("decision") == "keep", 0).otherwise(1)).alias("d"))
    each = one.groupBy("institution", "member").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).where(F.col("n") == n_runs)
    return each.groupBy("institution").agg(F.count(F.lit(1)).alias("n_common"), F.count_if(F.col("lo") != F.col("hi")).alias("n_flipped")).withColumn("flip_rate", rate(F.col("n_flipped"), F.col("n_common")))


def deltas(members: DataFrame, baseline: str) -> DataFrame:
    """(institution, run, n_only, n_missing) of each other run against the baseline; runs that agree are left out."""
    held = members.select("institution", "run", "member").distinct()
    base = held.where(F.col("run") == baseline).select("institution", "member", F.lit(True).alias("in_base"))
    other = held.where(F.col("run") != baseline)
    runs = other.select("institution", "run").distinct()
    want = base.join(runs, "institution").select("institution", "run", "member", "in_base")
    full = other.withColumn("in_run", F.lit(True)).join(want, ["institution", "run", "member"], "full")
    out = full.groupBy("institution", "run").agg(F.count_if(F.col("in_base").isNull()).alias("n_only"), F.count_if(F.col("in_run").isNull()).alias("n_missing"))
    return out.where("n_only > 0 OR n_missing > 0")


def completeness(artifacts: DataFrame) -> DataFrame:
    """(run, artifact, n): institutions with a non-empty artifact."""
    return artifacts.where("size > 0").groupBy("run", "artifact").agg(F.count_distinct("institution").alias("n"))


def most_diverged(stages: DataFrame) -> DataFrame:
    """The stage with most divergences, the first in order on ties, no row where none diverged; stages(stage, position, n_diverged)."""
    return stages.where("n_diverged > 0").orderBy(F.desc("n_diverged"), F.asc_nulls_last("position"), "stage").limit(1).select("stage", "n_diverged")
