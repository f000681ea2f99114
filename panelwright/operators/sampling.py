"""Frames and samples: deterministic draws, apportionment, stratified quotas.

Draws order rows by a hash of (seed, key), so they do not depend on how a
table is partitioned; a draw that cannot be filled is refused, never cut
short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_AGE_SECONDS = 3600.0


class ShortDraw(ValueError):
    """The pool holds fewer rows than were asked for."""


def uniform(seed: int, *key: str) -> Column:
    """A uniform number in (0, 1) from the seed and the row's key."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 52)


def draw_uniform(pool: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """``size`` rows with their draw_pos; any prefix of the draw is itself a uniform sample."""
    _refuse_short(pool, size)
    ordered = pool.withColumn("u_", uniform(seed, key)).orderBy("u_", key).limit(size)
    return ordered.withColumn("draw_pos", F.row_number().over(Window.orderBy("u_", key))).drop("u_")


def draw_weighted(pool: DataFrame, size: int, seed: int, key: str, weight: str) -> DataFrame:
    """Without replacement with probability proportional to the weight: the largest log(u) / weight; ties by key."""
    _refuse_short(pool, size)
    rank = F.log(uniform(seed, key)) / F.greatest(F.col(weight).cast("double"), F.lit(MIN_AGE_SECONDS))
    ordered = pool.withColumn("r_", rank).orderBy(F.desc("r_"), key).limit(size)
    return ordered.withColumn("draw_pos", F.row_number().over(Window.orderBy(F.desc("r_"), key))).drop("r_")


def draw_two_tier(first: DataFrame, second: DataFrame, size: int, seed: int, key: str, weight: str) -> DataFrame:
    """Uniformly from the first pool; what it lacks, weighted from the second."""
    have = first.count()
    top = draw_uniform(first, min(size, have), seed, key).drop(weight)
    if have >= size:
        return top
    rest = draw_weighted(second, size - have, seed, key, weight).withColumn("draw_pos", F.col("draw_pos") + have).drop(weight)
    return top.unionByName(rest)


def _refuse_short(pool: DataFrame, size: int) -> None:
    if size < 0 or size > (have := pool.count()):
        raise ShortDraw(f"{size} rows asked of a pool of {have if size >= 0 else 'any size'}")


def largest_remainder(weights: DataFrame, total: int, key: str, weight: str) -> DataFrame:
    """(key, share): total split in proportion to the (whole) weights, leftovers to the largest fractions, ties by key."""
    every = Window.partitionBy(F.lit(0))  # as many rows as levels
    exact = weights.select(key, (F.lit(total).cast("decimal(19,0)") * F.col(weight).cast("decimal(19,0)")).alias("part"), F.sum(weight).over(every).cast("decimal(19,0)").alias("whole"))
    exact = exact.select(key, F.expr("CAST(part div whole AS BIGINT)").alias("base"), F.expr("part % whole").alias("left_over"))
    nth = F.row_number().over(every.orderBy(F.desc("left_over"), key))
    left = F.lit(total) - F.sum("base").over(every)
    return exact.withColumn("nth", nth).withColumn("left", left).select(key, (F.col("base") + F.when(F.col("nth") <= F.col("left"), 1).otherwise(0)).cast("long").alias("share"))


def level_targets(levels: DataFrame, size: int) -> DataFrame:
    """(level, target) of levels (level, available, floor): a level with a floor owes exactly that; the others share the rest of ``size``.

    They share by largest remainder of what they hold, ties by level. Raises
    ShortDraw where a floor or a share is more than a level holds, or the
    floors do not leave a rest that fits.
    """
    known = levels.select("level", F.coalesce("available", F.lit(0)).alias("available"), "floor")
    fixed = F.coalesce(F.sum("floor"), F.lit(0))
    free = F.coalesce(F.sum(F.when(F.col("floor").isNull(), F.col("available"))), F.lit(0))
    facts = known.agg(fixed.alias("fixed"), free.alias("free"), F.coalesce(F.bool_or(F.col("floor") > F.col("available")), F.lit(False)).alias("over")).first()
    rest = size - facts["fixed"]
    if facts["over"] or rest < 0 or rest > facts["free"]:
        raise ShortDraw(f"floors of {facts['fixed']} and levels of {facts['free']} do not make {size}")
    shares = largest_remainder(known.where("floor IS NULL AND available > 0"), rest, "level", "available")
    return known.join(shares, "level", "left").select("level", F.coalesce("floor", "share", F.lit(0)).cast("long").alias("target"))


def _apportion(weights: dict[str, int], total: int) -> dict[str, int]:
    whole = sum(weights.values())
    shares = {k: total * w // whole for k, w in weights.items()}
    order = sorted(weights, key=lambda k: (-(total * weights[k] % whole), k))
    for k in order[: total - sum(shares.values())]:
        shares[k] += 1
    return shares


def water_fill(headroom: dict[str, int], weights: dict[str, int], target: int) -> dict[str, int]:
    """Spread the target in proportion to the weights, clipped at each key's headroom and spread again."""
    if target > sum(headroom.values()):
        raise ShortDraw(f"{target} asked of {sum(headroom.values())}")
    placed = dict.fromkeys(headroom, 0)
    while (missing := target - sum(placed.values())) > 0:
        open_ = {k: max(weights[k], 1) for k in headroom if headroom[k] > placed[k]}
        for k, want in _apportion(open_, missing).items():
            placed[k] += min(want, headroom[k] - placed[k])
    return placed


def take_quotas(rows: DataFrame, quotas: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """The first rows of each stratum in hash order, as many as its quota; quotas: (stratum, target), strata without one give none.

    A stratum may be large, so only rows whose hash is small enough to be
    drawn (with a wide margin) are ranked; should that ever leave a stratum
    short, all rows are.
    """
    wanted = quotas.select(F.col(quotas.columns[0]).alias(stratum), F.col(quotas.columns[1]).alias("target_"))
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_")).join(wanted, stratum).where("target_ > 0")  # one row per stratum
    limit = (F.col("target_") + 10 * F.sqrt("target_") + 100) / F.col("n_")
    met = rows.withColumn("u_", uniform(seed, key)).join(sizes.withColumn("limit_", limit), stratum)
    near = met.where("u_ < limit_")
    found = near.groupBy(stratum).agg(F.count(F.lit(1)).alias("near_"))
    short = sizes.join(found, stratum, "left").where(F.coalesce("near_", F.lit(0)) < F.least("target_", "n_"))
    pool = near if short.isEmpty() else met
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy("u_", key))
    return pool.withColumn("nth_", nth).where("nth_ <= target_").drop("nth_", "u_", "limit_", "n_", "target_")


def stratified(rows: DataFrame, size: int, stratum: str, key: str, seed: int) -> DataFrame:
    """Equal quotas per stratum; what small strata lack is spread one by one over the others.

    Row r of a stratum stands in round r; taking whole rounds first, strata in
    hash order within a round, is that spreading.
    """
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(uniform(seed, key), key))
    turn = F.md5(F.concat(F.lit(f"{seed}|"), F.col(stratum).cast("string")))
    return rows.withColumn("round", nth).withColumn("turn_", turn).orderBy("round", "turn_").limit(size).drop("turn_")


def inspection_snapshot(sweeps: DataFrame) -> DataFrame:
    """(uid, last_inspected_at, last_run_id, n_sweeps) of dated sweeps (uid, at, run_id, pos); the earlier row wins a tie."""
    dated = sweeps.where("at IS NOT NULL")
    return dated.groupBy("uid").agg(F.max("at").alias("last_inspected_at"), F.max_by("run_id", F.struct("at", (-F.col("pos")).alias("p"))).alias("last_run_id"), F.count(F.lit(1)).alias("n_sweeps"))


def composition(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n): the frame's counts by each of the columns, in one pass."""
    every = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("d")
    return frame.select(every).groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))
