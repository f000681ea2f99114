"""Connected components by alternating star steps, wholly in joins and pre-aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut


def _handed(edges: DataFrame, up: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = edges.join(least, "u")
    if up:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (u, v) of any orderable type; root is the least node of the component."""
    edges = cut(links.where("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    edges, before = edges.where("u > v"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _handed(both, True).where("u > v").distinct()
        edges = cut(_handed(large, False).where("u > v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == before:
            return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
        before = now


def cliques_or_singletons(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): a component whose every pair is linked stays together, any other falls into single nodes."""
    found = nodes.select("node").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = pairs.join(found.withColumnRenamed("node", "u"), "u").groupBy("root").agg(F.count(F.lit(1)).alias("links"))
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(edges, "root", "left")
    whole = sizes.select("root", (F.coalesce("links", F.lit(0)) * 2 == F.col("n") * (F.col("n") - 1)).alias("clique"))
    return found.join(whole, "root").select("node", F.when(F.col("clique"), F.col("root")).otherwise(F.col("node")).alias("root"))
