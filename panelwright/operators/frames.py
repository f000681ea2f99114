"""Frames by cell: what a registry holds per (country, level), how a stratum's size is shared over it, and the draw."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import with_row_index
from .sampling import ShortDraw, largest_remainder, take_quotas, uniform


class RepeatedClaim(ValueError):
    """A country belongs to two strata."""


def classify_cells(master: DataFrame, inspected: DataFrame, strata: DataFrame) -> DataFrame:
    """(stratum, country, level, n_never, n_again): rows of master (uid, country, level) never inspected and inspected before, per cell.

    strata (stratum, country); a country in two of them is refused, one in
    none takes no part.
    """
    twice = [r["country"] for r in strata.groupBy("country").agg(F.count_distinct("stratum").alias("n")).where("n > 1").orderBy("country").limit(20).collect()]
    if twice:
        raise RepeatedClaim(f"claimed by two strata: {twice}")
    seen = inspected.select("uid").distinct().withColumn("seen", F.lit(True))
    rows = master.join(seen, "uid", "left").join(strata.distinct(), "country")
    return rows.groupBy("stratum", "country", "level").agg(F.count_if(F.col("seen").isNull()).alias("n_never"), F.count_if("seen").alias("n_again"))


def _shared(room: dict[str, int], weights: dict[str, int], total: int) -> dict[str, int]:
    """total over the keys in proportion to the weights, never over a key's room; what a full key leaves is shared again."""
    if total > sum(room.values()):
        raise ShortDraw(f"{total} asked of {sum(room.values())}")
    out, open_ = dict.fromkeys(room, 0), {k for k in room if room[k] > 0}
    while total:
        whole = sum(weights[k] for k in open_)
        parts = {k: divmod(total * weights[k], whole) for k in open_}
        extra = total - sum(q for q, _ in parts.values())
        first = set(sorted(open_, key=lambda k: (-parts[k][1], k))[:extra])
        for k, (q, _) in parts.items():
            got = min(q + (k in first), room[k] - out[k])
            out[k] += got
            total -= got
        open_ = {k for k in open_ if out[k] < room[k]}
    return out


def allocate(cells: DataFrame, specs: DataFrame, floors: DataFrame) -> DataFrame:
    """(stratum, country, level, take): how many rows each cell gives.

    cells (stratum, country, level, n), specs (stratum, size, cap), floors
    (stratum, level, floor). A level with a floor gives exactly that, the
    others share the rest by largest remainder of what they hold. Levels are
    served scarcest first; within one, countries share in proportion to what
    they hold, and no country gives more than ``cap`` over all levels. What
    does not fit is refused, never drawn short. A stratum's cells are as many
    as its countries times its levels, so each is settled in one group.
    """
    told = floors.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("level", "floor"))).alias("floors"))
    rows = cells.where("n > 0").join(specs, "stratum").join(told, "stratum", "left")

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        size, cap, fixed = int(frame["size"].iloc[0]), int(frame["cap"].iloc[0]), dict(frame["floors"].iloc[0] or {})
        held = frame.groupby("level")["n"].sum().astype(int).to_dict()
        rest = size - sum(fixed.values())
        free = {level: n for level, n in held.items() if level not in fixed}
        if rest < 0 or rest > sum(free.values()) or any(n > held.get(level, 0) for level, n in fixed.items()):
            raise ShortDraw(f"stratum {frame['stratum'].iloc[0]}: floors {fixed} and levels {held} do not make {size}")
        targets = {**fixed, **(_shared(free, free, rest) if rest else {})}
        left = dict.fromkeys(frame["country"], cap)
        out = []
        for level in sorted(held, key=lambda x: (held[x], x)):
            own = frame[frame["level"] == level].set_index("country")["n"].astype(int).to_dict()
            for country, take in _shared({c: min(n, left[c]) for c, n in own.items()}, own, targets.get(level, 0)).items():
                left[country] -= take
                if take:
                    out.append((frame["stratum"].iloc[0], country, level, take))
        return pd.DataFrame(out, columns=["stratum", "country", "level", "take"])

    return rows.groupBy("stratum").applyInPandas(settle, "stratum string, country string, level string, take long")


def in_hash_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows with draw_pos from 1 in hash order, so that any prefix is itself a uniform sample; sorted by ranges, not in one task."""
    ordered = rows.withColumn("u_", uniform(seed, key)).repartitionByRange("u_", key).sortWithinPartitions("u_", key)
    return with_row_index(ordered, "draw_pos").withColumn("draw_pos", F.col("draw_pos") + 1).drop("u_")


def draw_cells(rows: DataFrame, plan: DataFrame, key: str, seed: int) -> DataFrame:
    """The planned number of rows of each (country, level), then the whole in hash order with draw_pos."""
    cell = F.concat_ws("|", F.col("country"), F.col("level"))
    quotas = plan.select(cell.alias("cell"), F.col("take").alias("target"))
    taken = take_quotas(rows.withColumn("cell", cell), quotas, "cell", key, seed).drop("cell")
    return in_hash_order(taken, key, seed + 1)


def build_frame(master: DataFrame, inspected: DataFrame, strata: DataFrame, specs: DataFrame, floors: DataFrame, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(frame, plan): cells counted, sizes allocated over the never inspected, rows drawn and put in hash order."""
    cells = classify_cells(master, inspected, strata).select("stratum", "country", "level", F.col("n_never").alias("n"))
    plan = allocate(cells, specs, floors)
    pool = master.join(inspected.select("uid").distinct(), "uid", "left_anti")
    return draw_cells(pool, plan, key, seed), plan


def subset(frame: DataFrame, size: int, key: str, seed: int) -> DataFrame:
    """A uniform subset of a frame, in a new draw order; refused if the frame is smaller."""
    if size > frame.count():
        raise ShortDraw(f"{size} rows asked of a smaller frame")
    return in_hash_order(frame.drop("draw_pos").withColumn("u_", uniform(seed, key)).orderBy("u_", key).limit(size).drop("u_"), key, seed + 1)


def subset_by_stratum(frame: DataFrame, per_stratum: DataFrame, strata: DataFrame, key: str, seed: int) -> DataFrame:
    """A fixed number of rows of each stratum; per_stratum (stratum, size), strata (stratum, country); short strata are refused."""
    rows = frame.drop("draw_pos").join(strata.distinct(), "country")
    lacking = per_stratum.join(rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), "stratum", "left").where("coalesce(n, 0) < size").limit(20).collect()
    if lacking:
        raise ShortDraw(f"too few rows in {[r['stratum'] for r in lacking]}")
    return in_hash_order(take_quotas(rows, per_stratum.select("stratum", "size"), "stratum", key, seed), key, seed + 1)


def ages(snapshot: DataFrame, at: str) -> DataFrame:
    """(uid, age_seconds): time from the last inspection to the snapshot; null where none is dated."""
    return snapshot.select("uid", (F.unix_timestamp(F.lit(at).cast("timestamp")) - F.unix_timestamp(F.col("last_inspected_at").cast("timestamp"))).alias("age_seconds"))


def sidecar(frame: DataFrame, plan: DataFrame) -> DataFrame:
    """(country, level, planned, drawn): what was planned and what the frame holds."""
    drawn = frame.groupBy("country", "level").agg(F.count(F.lit(1)).alias("drawn"))
    planned = plan.groupBy("country", "level").agg(F.sum("take").alias("planned"))
    return planned.join(drawn, ["country", "level"], "full").select("country", "level", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("drawn", F.lit(0)).alias("drawn"))


__all__ = ["RepeatedClaim", "ShortDraw", "ages", "allocate", "build_frame", "classify_cells", "draw_cells", "in_hash_order", "largest_remainder", "sidecar", "subset", "subset_by_stratum"]
