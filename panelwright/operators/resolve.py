"""Entity resolution: one winner per key, shared hosts, interval and span joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

CONFIDENCE = ("low", "medium", "high")


def confidence_rank(confidence: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, CONFIDENCE)), confidence), F.lit(0))


def winning(observations: DataFrame, uid: str, precedence: str = "confidence-then-recency") -> DataFrame:
    """Of each uid the best observation, how many there were, the runs it supersedes and the other hosts.

    Columns read: uid, confidence, run_date, run_id, host.
    """
    recency = [F.col("run_date"), F.col("run_id")]
    order = [confidence_rank(F.col("confidence")), *recency] if precedence == "confidence-then-recency" else [*recency, confidence_rank(F.col("confidence"))]
    best = F.max_by(F.struct(*[c for c in observations.columns if c != uid]), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]))
    grouped = observations.groupBy(uid).agg(best.alias("w"), F.count(F.lit(1)).alias("n_observations"), F.array_sort(F.collect_set("run_id")).alias("runs"), F.array_sort(F.collect_set("host")).alias("hosts"))
    others = lambda column, own: F.array_join(F.array_remove(F.col(column), own), "|")
    return grouped.select(uid, "w.*", "n_observations", others("runs", F.col("w.run_id")).alias("superseded_runs"), others("hosts", F.coalesce(F.col("w.host"), F.lit(""))).alias("conflicting_hosts"))


def shared_counts(rows: DataFrame, column: str, name: str = "n_sharing") -> DataFrame:
    """Each row with how many rows hold its value; blank values count for none. Counts come by an aggregate and a join, so a hot value splits."""
    value = F.nullif(F.col(column), F.lit(""))
    counts = rows.where(value.isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return rows.join(counts, column, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def top_shared(rows: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most shared values held by more than one row: count descending, then value."""
    counts = rows.where(F.nullif(F.col(column), F.lit("")).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1").orderBy(F.desc("n"), column).limit(n)


def first_usable(rows: DataFrame, group: str, position: str, host: str, usable: Column) -> DataFrame:
    """(group, host, rank) of the first usable host of each group; null where none is."""
    first = F.min_by(host, F.when(usable, F.col(position)))
    return rows.groupBy(group).agg(F.when(F.bool_or(usable), first).alias("host"), F.min(F.when(usable, F.col(position))).alias("rank"))


def dedupe_ordered(rows: DataFrame, group: str, key: str, *order: str) -> DataFrame:
    """Of each key within a group the first row in the order."""
    nth = F.row_number().over(Window.partitionBy(group, key).orderBy(*order))
    return rows.withColumn("nth_", nth).where("nth_ = 1").drop("nth_")


def overlapping(a: DataFrame, b: DataFrame, group: str, width: int) -> DataFrame:
    """(group, a_id, b_id): pairs of half-open spans (id, start, end) of one group that overlap, by equi-join on buckets of ``width``.

    A pair is kept in the bucket where its overlap starts, so each comes once.
    """
    cells = lambda df, side: df.select(group, F.col("id").alias(f"{side}_id"), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("cell"))
    met = cells(a.where("start < end"), "a").join(cells(b.where("start < end"), "b"), [group, "cell"])
    lower = F.greatest("a_start", "b_start")
    return met.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.floor(lower / width) == F.col("cell"))).select(group, "a_id", "b_id")


def not_overlapping(a: DataFrame, b: DataFrame, group: str, width: int) -> DataFrame:
    """The spans of a that no span of b in the group overlaps."""
    hit = overlapping(a, b, group, width).select(group, F.col("a_id").alias("id")).distinct()
    return a.join(hit, [group, "id"], "left_anti")


def host_owner(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """(id, owner): 'own', 'other' or 'unknown' by whether the URL's host is this or another institution's; urls(id, institution, host), hosts(institution, host)."""
    pairs = hosts.select("institution", "host").distinct().withColumn("own", F.lit(True))
    taken = hosts.select("host").distinct().withColumn("taken", F.lit(True))
    met = urls.join(pairs, ["institution", "host"], "left").join(taken, "host", "left")
    return met.select("id", F.when(F.col("own"), "own").when(F.col("taken"), "other").otherwise("unknown").alias("owner"))


def parent_chain(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ancestor, depth): the closure of child-parent edges over the nodes, depth 0 included, however deep.

    A walk ends where a node has no parent or comes to a node it has been
    at; with several ways to an ancestor the shortest counts.
    """
    up = edges.select(F.col("child").alias("ancestor"), "parent").where("parent IS NOT NULL").distinct()
    out = cut(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).distinct())
    step, depth = out, 0
    while True:
        depth += 1
        fresh = step.join(up, "ancestor").select("node", F.col("parent").alias("ancestor")).distinct().join(out, ["node", "ancestor"], "left_anti")
        step = cut(fresh.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            return out
        out = cut(out.union(step)) if depth % 8 == 0 else out.union(step)
