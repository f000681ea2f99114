"""Queries on frames and identities: cells, allocation, draws, subsets, canonical hashes, signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import frames
from ..session import table
from .fixtures import ctes, rows

#: The registry: institutions with their country and level; every fifth has been inspected.
MASTER = "SELECT c_custkey AS uid, 'N' || c_nationkey AS country, c_mktsegment AS level FROM {customer}"
INSPECTED = "SELECT c_custkey AS uid FROM {customer} WHERE c_custkey % 5 = 0"
STRATA = "SELECT 'R' || n_regionkey AS stratum, 'N' || n_nationkey AS country FROM {nation} WHERE n_regionkey < 3"


def _inputs(spark, sf):
    return rows(spark, sf, MASTER), rows(spark, sf, INSPECTED), rows(spark, sf, STRATA)


def frame_cells(spark, sf):
    return frames.classify_cells(*_inputs(spark, sf))


def _plan(spark, sf):
    return frames.classify_cells(*_inputs(spark, sf)).select("country", "level", F.least(F.col("n_never"), F.lit(3)).alias("take"))


def cell_draw(spark, sf):
    return frames.draw_cells(rows(spark, sf, MASTER), _plan(spark, sf), "uid", 11)


def frame_sidecar(spark, sf):
    return frames.sidecar(cell_draw(spark, sf), _plan(spark, sf))


def frame_allocation(spark, sf):
    """Ten rows of each stratum, one of them with the level MACHINERY, at most six of a country."""
    cells = frames.classify_cells(*_inputs(spark, sf)).select("stratum", "country", "level", F.col("n_never").alias("n"))
    strata = cells.select("stratum").distinct()
    return frames.allocate(cells, strata.select("stratum", F.lit(10).alias("size"), F.lit(6).alias("cap")), strata.select("stratum", F.lit("MACHINERY").alias("level"), F.lit(1).alias("floor")))


def built_frame(spark, sf):
    """The whole way: the drawn rows per stratum and level (which rows they are is the hash's choice)."""
    master, inspected, strata = _inputs(spark, sf)
    names = strata.select("stratum").distinct()
    specs, floors = names.select("stratum", F.lit(10).alias("size"), F.lit(6).alias("cap")), names.select("stratum", F.lit("MACHINERY").alias("level"), F.lit(1).alias("floor"))
    frame, _ = frames.build_frame(master, inspected, strata, specs, floors, "uid", 5)
    return frame.join(strata, "country").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == "MACHINERY").alias("n_floor"), F.count_if(F.col("uid") % 5 == 0).alias("n_inspected"))


def frame_subset(spark, sf):
    return frames.subset(rows(spark, sf, MASTER), 60, "uid", 21)


def stratified_subset(spark, sf):
    strata = rows(spark, sf, STRATA)
    return frames.subset_by_stratum(rows(spark, sf, MASTER), strata.select("stratum", F.lit(7).alias("size")).distinct(), strata, "uid", 31)


def inspection_ages(spark, sf):
    seen = rows(spark, sf, "SELECT o_custkey AS uid, max(CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE o_orderdate END) AS last_inspected_at FROM {orders} GROUP BY o_custkey")
    return frames.ages(seen, "2005-01-01 00:00:00")


def config_hashes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("a_priority"))
    return o.select("o_orderkey", identity.config_hash(o, ("o_custkey",)).alias("config_hash"))


def canonical_documents(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.struct(F.col("c_name").alias("z"), F.map_from_arrays(F.array(F.lit("q"), F.lit("b")), F.array("c_nationkey", F.lit(1))).alias("a")).alias("doc"))
    return c.select("c_custkey", identity.canonical_json(c, ["doc"]).alias("json"))


def support_ids(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return li.select(identity.support_id(li, ["l_orderkey", "l_linenumber", "l_linestatus"]).alias("support_id")).groupBy("support_id").agg(F.count(F.lit(1)).alias("n"))


def observation_ids(spark, sf):
    return table(spark, sf, "lineitem").select(identity.composite_id(F.col("l_orderkey").cast("string"), F.concat(F.lit("A"), F.col("l_linenumber").cast("string"))).alias("observation_id"), "l_suppkey")


def minted_run_ids(spark, sf):
    return table(spark, sf, "events").select("event_id", identity.mint_run_id(F.col("ts").cast("timestamp"), F.col("event_id").cast("string")).alias("run_id"))


def minhash_signatures(spark, sf):
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), text.words(F.coalesce("text", F.lit(""))).alias("w"))
    return identity.signatures(words.select("key", text.shingles(F.col("w")).alias("items")), "panel-minhash").select("key", "digest")


def syndication_group_ids(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("scope"), (F.col("doc_id") % 40).alias("group"), F.col("doc_id").alias("member"))
    return identity.group_ids(d, "v1")


QUERIES = {
    f.__name__: f
    for f in (
        frame_cells, cell_draw, frame_sidecar, frame_allocation, built_frame, frame_subset, stratified_subset, inspection_ages, config_hashes, canonical_documents, support_ids,
        observation_ids, minted_run_ids, minhash_signatures, syndication_group_ids,
    )
}

_U = "(CAST('0x' || left(md5('{}|' || uid), 13) AS BIGINT) + 0.5) / 4503599627370496.0"
CELLS = ctes(m=MASTER, i=INSPECTED, s=STRATA) + ", c AS (SELECT stratum, country, level, count(*) FILTER (uid NOT IN (SELECT uid FROM i)) AS n_never, count(*) FILTER (uid IN (SELECT uid FROM i)) AS n_again FROM m JOIN s USING (country) GROUP BY 1, 2, 3)"
DRAWN = CELLS + f", r AS (SELECT uid, country, level, row_number() OVER (PARTITION BY country, level ORDER BY {_U.format(11)}, uid) AS nth FROM m), t AS (SELECT r.* FROM r JOIN c USING (country, level) WHERE nth <= least(n_never, 3)), f AS (SELECT uid, country, level, row_number() OVER (ORDER BY {_U.format(12)}, uid) AS draw_pos FROM t)"
ORACLES = {
    "frame_cells": CELLS + " SELECT * FROM c",
    "cell_draw": DRAWN + " SELECT * FROM f",
    "frame_sidecar": DRAWN + ", d AS (SELECT country, level, count(*) AS drawn FROM f GROUP BY 1, 2) SELECT country, level, least(n_never, 3) AS planned, coalesce(drawn, 0) AS drawn FROM c LEFT JOIN d USING (country, level)",
    "built_frame": ctes(s=STRATA) + "SELECT DISTINCT stratum, CAST(10 AS BIGINT) AS n, CAST(1 AS BIGINT) AS n_floor, CAST(0 AS BIGINT) AS n_inspected FROM s",
    "frame_subset": ctes(m=MASTER) + f", t AS (SELECT * FROM m ORDER BY {_U.format(21)}, uid LIMIT 60) SELECT uid, country, level, row_number() OVER (ORDER BY {_U.format(22)}, uid) AS draw_pos FROM t",
    "stratified_subset": ctes(m=MASTER, s=STRATA) + f", t AS (SELECT m.*, stratum FROM m JOIN s USING (country) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {_U.format(31)}, uid) <= 7) SELECT uid, country, level, stratum, row_number() OVER (ORDER BY {_U.format(32)}, uid) AS draw_pos FROM t",
    "inspection_ages": "WITH s AS (SELECT o_custkey AS uid, max(CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE o_orderdate END) AS at FROM orders GROUP BY 1) SELECT uid, CAST(epoch(TIMESTAMP '2005-01-01 00:00:00') - epoch(at) AS BIGINT) AS age_seconds FROM s".replace(" AS at", " AS seen").replace("epoch(at)", "epoch(seen)"),
    "config_hashes": "SELECT o_orderkey, sha256('{\"a_priority\":' || CASE WHEN o_orderpriority = '5-LOW' THEN 'null' ELSE '\"' || o_orderpriority || '\"' END || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS config_hash FROM orders",
    "canonical_documents": "SELECT c_custkey, '{\"doc\":{\"a\":{\"b\":1,\"q\":' || c_nationkey || '},\"z\":\"' || c_name || '\"}}' AS json FROM customer",
    "support_ids": "SELECT 'sup-' || left(sha256('{\"l_linenumber\":' || l_linenumber || ',\"l_linestatus\":\"' || l_linestatus || '\",\"l_orderkey\":' || l_orderkey || '}'), 20) AS support_id, count(*) AS n FROM lineitem GROUP BY 1",
    "observation_ids": "SELECT l_orderkey || ':A' || l_linenumber AS observation_id, l_suppkey FROM lineitem",
    "minted_run_ids": "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || left(md5(CAST(event_id AS VARCHAR)), 4) AS run_id FROM events",
}
