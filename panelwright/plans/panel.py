"""Queries on registries, activities and sources: joins, integrity, sampling, combine rules, repair, event folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import combine, integrity, repair, resolve, sampling
from ..operators.components import cliques_or_singletons
from ..session import table
from ..streaming import events as ev


def _orders(spark, sf):
    return table(spark, sf, "orders")


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


# Integrity: activities are orders, sources are line items; some of each are left out to have findings.
def _some_orders(spark, sf):
    return _orders(spark, sf).where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("activity"), "o_custkey")


def _sources(spark, sf):
    return _lines(spark, sf).select(F.col("l_orderkey").alias("activity"), F.col("l_linenumber").alias("number"), "l_suppkey")


def fk_orphans(spark, sf):
    return integrity.orphans(_sources(spark, sf), _some_orders(spark, sf), ["activity"])


def uncovered_parents(spark, sf):
    return integrity.uncovered(_some_orders(spark, sf), _sources(spark, sf).where("number > 3"), ["activity"])


def missing_dimension(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey % 17 <> 0").select(F.col("c_custkey").alias("k"))
    return integrity.missing_from(c, "k", _orders(spark, sf).select(F.col("o_custkey").alias("k")), _lines(spark, sf).select((F.col("l_suppkey") + 0).alias("k")))


def summary_count_mismatch(spark, sf):
    declared = _orders(spark, sf).select(F.col("o_orderkey").alias("activity"), (F.col("o_orderkey") % 8).alias("declared"))
    return integrity.count_mismatch(declared, _sources(spark, sf), "activity")


def sequence_gaps(spark, sf):
    return integrity.sequence_gaps(_sources(spark, sf).select("activity", "number").distinct().where("(activity + number) % 9 <> 0"), "activity", "number")


def keep_wins_dedup(spark, sf):
    e = table(spark, sf, "events")
    url = F.concat(F.lit("u"), (F.col("event_id") % 700).cast("string"))
    return integrity.keep_wins(e.where("event_type = 'view'").select(url.alias("url")), e.where("event_type IN ('click', 'error')").select(url.alias("url"), F.when(F.col("event_type") == "click", "keep").otherwise("drop").alias("decision")))


def table_comparison(spark, sf):
    o = _orders(spark, sf)
    return integrity.compare(o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("v")), o.where("o_orderkey % 7 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("v")), "o_orderkey", "v")


def inverse_relations(spark, sf):
    p = _lines(spark, sf).select(F.col("l_partkey").alias("x"), (-1 - F.col("l_suppkey")).alias("y"), "l_returnflag").groupBy("x", "y").agg(F.min("l_returnflag").alias("f"), F.max("l_returnflag").alias("g"))
    said = F.when(F.col("f") == "A", "broader").otherwise("same")
    back = F.when(F.col("g") == "R", "narrower").otherwise("same")
    rel = p.select(F.col("x").alias("a"), F.col("y").alias("b"), said.alias("value")).union(p.select("y", "x", back))
    return integrity.asymmetric(rel, {"broader": "narrower", "narrower": "broader", "same": "same"})


def conditional_fill(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.concat(F.lit("w"), F.col("c_custkey").cast("string"))).alias("website"))
    o = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("o"), F.col("c_custkey").cast("string")).alias("website"))
    return integrity.filled(c, o, "c_custkey", "website")


def master_overlay(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("w"), (F.col("c_custkey") % 100).cast("string"))).alias("website"))
    o = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select("c_custkey", F.concat(F.lit("w"), (F.col("c_custkey") % F.when(F.col("c_custkey") % 5 == 0, 50).otherwise(100)).cast("string")).alias("site"))
    return integrity.with_status(c, o, "c_custkey", "website", "site").groupBy("vs_master").agg(F.count(F.lit(1)).alias("n"))


# Resolution
def _picks(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    conf = F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("k") % 3)
    return e.select(F.col("user_id").alias("uid"), conf.alias("confidence"), F.date_format("ts", "yyyy-MM-dd").alias("run_date"), F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("run_id"), F.concat(F.lit("h"), (F.col("k") % 4).cast("string")).alias("host"))


PICKS = "WITH p AS (SELECT user_id AS uid, ['low', 'medium', 'high'][CAST(props->>'k' AS INT) % 3 + 1] AS confidence, CAST(props->>'k' AS INT) % 3 AS c, strftime(ts, '%Y-%m-%d') AS run_date, 'r' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS run_id, 'h' || (CAST(props->>'k' AS INT) % 4) AS host FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY {}) AS nth FROM p) SELECT uid, any_value(confidence) FILTER (nth = 1) AS confidence, any_value(run_date) FILTER (nth = 1) AS run_date, any_value(run_id) FILTER (nth = 1) AS run_id, any_value(host) FILTER (nth = 1) AS host, count(*) AS n_observations, coalesce(string_agg(DISTINCT run_id, '|' ORDER BY run_id) FILTER (nth > 1), '') AS superseded_runs, array_to_string(list_sort(list_filter(list(DISTINCT host), lambda h: h <> any_value_host)), '|') AS conflicting_hosts FROM (SELECT *, first_value(host) OVER (PARTITION BY uid ORDER BY nth) AS any_value_host FROM o) GROUP BY uid, any_value_host"


def latest_pick_per_key(spark, sf):
    return resolve.winning(_picks(spark, sf), "uid")


def latest_pick_by_recency(spark, sf):
    return resolve.winning(_picks(spark, sf), "uid", "recency-then-confidence")


def _spans(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    start = F.col("event_id") * 7 % 5000
    rows = e.select((F.col("user_id") % 20).alias("page"), F.col("event_id").alias("id"), start.alias("start"), (start + F.col("k") % 30).alias("end"), "event_type")
    return rows.where("event_type IN ('view', 'click')"), rows.where("event_type IN ('error', 'purchase')")


SPANS = "WITH s AS (SELECT user_id % 20 AS page, event_id AS id, event_id * 7 % 5000 AS start, event_id * 7 % 5000 + CAST(props->>'k' AS INT) % 30 AS stop, event_type FROM events), a AS (SELECT * FROM s WHERE event_type IN ('view', 'click')), b AS (SELECT * FROM s WHERE event_type IN ('error', 'purchase') AND start < stop) "


def span_overlap(spark, sf):
    return resolve.overlapping(*_spans(spark, sf), "page", 64)


def span_anti(spark, sf):
    a, b = _spans(spark, sf)
    return resolve.not_overlapping(a, b, "page", 64).select("page", "id", "start", "end")


def host_ownership(spark, sf):
    s = table(spark, sf, "supplier")
    hosts = s.select(F.col("s_suppkey").alias("institution"), F.concat(F.lit("h"), (F.col("s_suppkey") % 37).cast("string")).alias("host"))
    u = _lines(spark, sf).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("institution"), F.concat(F.lit("h"), (F.col("l_partkey") % 45).cast("string")).alias("host"))
    return resolve.host_owner(u, hosts).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


def parent_chain(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("world").alias("parent"))
    edges = n.union(r)
    return resolve.parent_chain(edges, edges.select(F.col("child").alias("node")))


def clique_groups(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("node"))
    links = d.where("node % 10 < 2").select(F.col("node").alias("u"), (F.col("node") + 1).alias("v")).union(d.where("node % 30 = 0").select("node", F.col("node") + 2))
    return cliques_or_singletons(d, links.join(d.select(F.col("node").alias("v")), "v", "left_semi").select("u", "v"))


# Sampling
def never_inspected_pools(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    seen = _orders(spark, sf).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    return c.join(seen, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count_if(F.col("seen").isNull()).alias("never"), F.count_if("seen").alias("again"))


def inspection_snapshot(spark, sf):
    o = _orders(spark, sf).select(F.col("o_custkey").alias("uid"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("at"), F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderkey").alias("pos"))
    return sampling.inspection_snapshot(o).withColumn("last_inspected_at", F.date_format("last_inspected_at", "yyyy-MM-dd"))


def frame_composition(spark, sf):
    return sampling.composition(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


def largest_remainder(spark, sf):
    w = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return sampling.largest_remainder(w, 317, "c_nationkey", "n")


def uniform_draw(spark, sf):
    return sampling.draw_uniform(table(spark, sf, "customer").select("c_custkey"), 100, 7, "c_custkey")


def weighted_draw(spark, sf):
    pool = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") * 1000).alias("age"))
    return sampling.draw_weighted(pool, 100, 7, "c_custkey", "age").select("c_custkey", "draw_pos")


def stratified_sample(spark, sf):
    return sampling.stratified(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), 53, "c_mktsegment", "c_custkey", 3)


def quota_draw(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    levels = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("available"))
    floors = levels.select(F.col("c_mktsegment").alias("level"), "available", F.when(F.col("c_mktsegment") == "MACHINERY", 11).alias("floor"))
    return sampling.take_quotas(c, sampling.level_targets(floors, 90), "c_mktsegment", "c_custkey", 5)


UNIFORM = "(CAST('0x' || left(md5('{seed}|' || {key}), 13) AS BIGINT) + 0.5) / 4503599627370496.0"


# Combine rules: units are orders, parts line items.
def _answers(spark, sf):
    v = F.get(F.array(*map(F.lit, ["yes", "no", "not_documented", "unknown", "not covered by this part", "pilot", "live"])), ((F.col("l_partkey") + F.col("l_linenumber")) % 7).cast("int"))
    return _lines(spark, sf).groupBy(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("part")).agg(F.min(v).alias("value"), F.max("l_discount").alias("probability"), F.min(F.col("l_tax") > 0.06).alias("failed"))


ANSWERS = "WITH a AS (SELECT l_orderkey AS unit, l_linenumber AS part, min(['yes', 'no', 'not_documented', 'unknown', 'not covered by this part', 'pilot', 'live'][CAST((l_partkey + l_linenumber) % 7 AS INT) + 1]) AS value, max(l_discount) AS probability, bool_and(l_tax > 0.06) AS failed FROM lineitem GROUP BY 1, 2), v AS (SELECT *, value <> 'not covered by this part' AS covered, CASE WHEN value = 'not covered by this part' THEN NULL WHEN failed THEN 'unknown' ELSE value END AS entered, value NOT IN ('not covered by this part', 'not_documented', 'unknown') AND NOT failed AS is_real FROM a), m AS (SELECT unit, CASE WHEN bool_or(entered = 'not_documented') THEN 'not_documented' WHEN bool_or(entered = 'unknown') THEN 'unknown' ELSE 'not_documented' END AS missing FROM v GROUP BY 1) "
ORDER = ("live", "pilot", "yes", "no", "not_documented", "unknown")


def combine_priority(spark, sf):
    return combine.priority_order(_answers(spark, sf), ORDER)


def combine_any_yes(spark, sf):
    return combine.any_yes(_answers(spark, sf).where("value NOT IN ('pilot', 'live')"))


def combine_first_section(spark, sf):
    return combine.first_section(_answers(spark, sf))


def combine_earliest(spark, sf):
    a = _answers(spark, sf).withColumn("value", F.when(F.col("value").isin("yes", "pilot", "live"), (2010 + F.col("unit") * F.col("part") % 20).cast("string")).otherwise(F.col("value"))).where("value <> 'no'")
    return combine.earliest_year(a)


def combine_highest(spark, sf):
    return combine.highest_probability(_answers(spark, sf))


def combine_list(spark, sf):
    return combine.combined_list(_answers(spark, sf), ("pilot", "live", "both"))


def _confidences(spark, sf):
    c = F.get(F.array(*map(F.lit, ["low", "medium", "unknown", "low", "medium", "low", "low", "high"])), ((F.col("l_partkey") + F.col("l_suppkey")) % 8).cast("int"))
    return _lines(spark, sf).select(F.col("l_orderkey").alias("activity"), c.alias("confidence"), (F.col("l_suppkey") % 3).alias("independence_group"))


def confidence_quorum(spark, sf):
    return combine.confidence_quorum(_confidences(spark, sf))


def best_confidence(spark, sf):
    return combine.best_confidence(_confidences(spark, sf).withColumnRenamed("activity", "unit"))


def flags_union(spark, sf):
    from ..functions.text import flags_union as union

    li = _lines(spark, sf).select("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, "none").otherwise(F.concat(F.lower("l_returnflag"), F.lit("; "), F.lower("l_linestatus"))).alias("f"))
    return li.groupBy("l_orderkey").agg(union(F.collect_set("f")).alias("flags"))


# Repair and contract
FIELDS = ["adoption_stage", "tool_name", "year_announced", "scope_notes", "activity_name"]


def _coded(spark, sf):
    pick = lambda n, m: F.when((F.col("o_orderkey") * n) % m == 0, F.lit("_NA_")).otherwise(F.concat(F.lit("v"), (F.col("o_orderkey") % 9).cast("string")))
    o = _orders(spark, sf).select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "confirms_activity").otherwise("ambiguous").alias("genai_evidence"), *[pick(n, m).alias(f) for f, n, m in zip(FIELDS, (1, 3, 5, 1, 1), (2, 4, 3, 5, 7))])
    return o


CODED = "WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'confirms_activity' ELSE 'ambiguous' END AS genai_evidence, " + ", ".join(f"CASE WHEN (o_orderkey * {n}) % {m} = 0 THEN '_NA_' ELSE 'v' || (o_orderkey % 9) END AS {f}" for f, n, m in zip(FIELDS, (1, 3, 5, 1, 1), (2, 4, 3, 5, 7))) + " FROM orders) "


def group_d_salvage(spark, sf):
    s = repair.salvage_missing(_coded(spark, sf), FIELDS)
    return s.select("o_orderkey", *FIELDS, F.array_join("salvaged_fields", ",").alias("salvaged"), F.array_join("unsalvageable_fields", ",").alias("stuck"))


def negative_row_salvage(spark, sf):
    s = repair.salvage_negative(_coded(spark, sf).withColumn("activity_name", F.lit("_NA_")).withColumn("tool_name", F.when(F.col("o_orderkey") % 3 != 0, "_NA_").otherwise(F.col("tool_name"))), FIELDS)
    return s.groupBy("genai_evidence", F.array_join("blanked_fields", ",").alias("blanked"), F.array_join("contradictory_fields", ",").alias("against")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("adoption_stage") == "_NA_").alias("n_na"))


def flags_salvage(spark, sf):
    raw = F.get(F.array(*map(F.lit, ["a ; b", "", "  ", " _NA_ ", "x;_NA_", "none"])), (F.col("o_orderkey") % 6).cast("int"))
    return _orders(spark, sf).groupBy(repair.salvage_flags(raw).alias("flags")).agg(F.count(F.lit(1)).alias("n"))


def contract_violations(spark, sf):
    li = _lines(spark, sf).withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rules = {"quantity_range": F.col("l_quantity").between(2, 49), "discount_cap": F.col("l_discount") <= 0.09, "flag_status": ~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")), "ship_late": F.year("l_shipdate") < 2001}
    return repair.violations(li, "row_id", rules).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))


def cross_row_consistency(spark, sf):
    return repair.inconsistent(_lines(spark, sf), "l_orderkey", ["l_returnflag", "l_linestatus"]).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_errors(spark, sf):
    rows = _orders(spark, sf).select(F.col("o_orderkey").alias("key"), F.when(F.year("o_orderdate") < 1998, "v1").otherwise("v2").alias("version"), F.col("o_orderstatus").alias("value"))
    vocabulary = spark.sql("SELECT * FROM VALUES ('v1', 'F'), ('v1', 'O'), ('v2', 'F'), ('v2', 'O'), ('v2', 'P') AS t(version, value)")
    return repair.vocabulary_errors(rows, vocabulary)


def version_steps(spark, sf):
    lists = _lines(spark, sf).groupBy(F.col("l_partkey").alias("item"), F.year("l_shipdate").alias("release")).agg(F.array_join(F.array_sort(F.collect_set("l_linenumber")), ",").alias("value_list"), (F.count(F.lit(1)) % 3).alias("label"))
    return repair.unstepped_versions(lists)


# Event folds
def _log(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.when(F.col("event_type") == "view", "stage_started").when(F.col("event_type") == "click", "stage_completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "resumed").otherwise("completed")
    staged = F.col("event_type").isin("view", "click")
    return e.select((F.col("user_id") % 50).alias("run_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.when(staged, F.concat(F.lit("s"), (F.col("k") % 6).cast("string"))).alias("stage"), F.round("value", 2).alias("units"), F.concat(F.lit("h"), (F.col("user_id") % 30).cast("string")).alias("host"), (F.col("k") % 4 == 0).alias("ok"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


LOG = "WITH l AS (SELECT user_id % 50 AS run_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'stage_started' WHEN 'click' THEN 'stage_completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'resumed' ELSE 'completed' END AS event, CASE WHEN event_type IN ('view', 'click') THEN 's' || (CAST(props->>'k' AS INT) % 6) END AS stage, round(value, 2) AS units, 'h' || (user_id % 30) AS host, CAST(props->>'k' AS INT) % 4 = 0 AS ok, epoch_us(ts) / 1e6 AS sec FROM events) "


def run_state_fold(spark, sf):
    return ev.run_status(_log(spark, sf))


def running_spend(spark, sf):
    s = ev.running_spend(_log(spark, sf).where("stage IS NOT NULL"), 80.0)
    return s.groupBy("run_id", "stage").agg(F.max("spent").alias("spent"), F.min(F.when(F.col("over_budget"), F.col("seq"))).alias("first_over"))


def spend_totals(spark, sf):
    return ev.spend_totals(_log(spark, sf).where("stage IS NOT NULL"))


def ledger_dedup(spark, sf):
    return ev.ledger(_log(spark, sf).select("run_id", "event", F.coalesce("stage", F.lit("-")).alias("stage")), ["run_id", "event", "stage"])


def host_breaker(spark, sf):
    return ev.host_breaker(_log(spark, sf), 3).select("host", "seq", "failures", "is_open")


def throttle_gaps(spark, sf):
    return ev.throttle_violations(_log(spark, sf), 200.0)


QUERIES = {f.__name__: f for f in (fk_orphans, uncovered_parents, missing_dimension, summary_count_mismatch, sequence_gaps, keep_wins_dedup, table_comparison, inverse_relations, conditional_fill, master_overlay, latest_pick_per_key, latest_pick_by_recency, span_overlap, span_anti, host_ownership, parent_chain, clique_groups, never_inspected_pools, inspection_snapshot, frame_composition, largest_remainder, uniform_draw, weighted_draw, stratified_sample, quota_draw, combine_priority, combine_any_yes, combine_first_section, combine_earliest, combine_highest, combine_list, confidence_quorum, best_confidence, flags_union, group_d_salvage, negative_row_salvage, flags_salvage, contract_violations, cross_row_consistency, vocabulary_errors, version_steps, run_state_fold, running_spend, spend_totals, ledger_dedup, host_breaker, throttle_gaps)}

_PICKED = "SELECT m.unit, coalesce(p.value, m.missing) AS value FROM m LEFT JOIN p USING (unit)"
_DEF = dict(zip(FIELDS, ("unknown", "unknown", "unknown", "none", "")))
_CUST_U = UNIFORM.format(seed="{seed}", key="c_custkey")
ORACLES = {
    "fk_orphans": "SELECT l_orderkey AS activity, l_linenumber AS number, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 <> 0)",
    "uncovered_parents": "SELECT o_orderkey AS activity, o_custkey FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)",
    "missing_dimension": "SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT l_suppkey FROM lineitem) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 17 <> 0)",
    "summary_count_mismatch": "WITH a AS (SELECT l_orderkey, count(*) AS actual FROM lineitem GROUP BY 1) SELECT o_orderkey AS activity, o_orderkey % 8 AS declared, coalesce(actual, 0) AS actual FROM orders LEFT JOIN a ON l_orderkey = o_orderkey WHERE o_orderkey % 8 <> coalesce(actual, 0)",
    "sequence_gaps": "WITH d AS (SELECT DISTINCT l_orderkey AS activity, l_linenumber AS number FROM lineitem WHERE (l_orderkey + l_linenumber) % 9 <> 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY activity ORDER BY number) AS INTEGER) AS expected FROM d) SELECT * FROM r WHERE number <> expected",
    "keep_wins_dedup": "WITH c AS (SELECT DISTINCT 'u' || (event_id % 700) AS url FROM events WHERE event_type = 'view'), d AS (SELECT 'u' || (event_id % 700) AS url, max(CAST(event_type = 'click' AS INT)) AS keep, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1) SELECT coalesce(c.url, d.url) AS url, CASE WHEN c.url IS NULL THEN 'url_mismatch' WHEN keep IS NULL THEN 'missing_decision' WHEN keep = 1 THEN 'kept' ELSE 'dropped' END AS status, coalesce(n, 0) > 1 AS duplicate_url FROM c FULL JOIN d ON c.url = d.url",
    "table_comparison": "WITH a AS (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'Z' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 7 <> 0) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.v IS DISTINCT FROM b.v",
    "inverse_relations": """WITH p AS (SELECT l_partkey AS x, -1 - l_suppkey AS y, min(l_returnflag) AS f, max(l_returnflag) AS g FROM lineitem GROUP BY 1, 2),
      v AS (SELECT x, y, CASE f WHEN 'A' THEN 'broader' ELSE 'same' END AS said, CASE g WHEN 'R' THEN 'narrower' ELSE 'same' END AS back FROM p),
      d AS (SELECT *, said = 'same' AND back = 'same' OR said = 'broader' AND back = 'narrower' AS agree FROM v)
      SELECT x AS a, y AS b, said AS value, back AS other FROM d WHERE NOT agree UNION ALL SELECT y, x, back, said FROM d WHERE NOT agree""",
    "conditional_fill": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'w' || c_custkey WHEN c_custkey % 2 = 0 THEN 'o' || c_custkey END AS website FROM customer",
    "master_overlay": "WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'w' || (c_custkey % 100) END AS website, CASE WHEN c_custkey % 3 <> 0 THEN 'w' || (c_custkey % CASE WHEN c_custkey % 5 = 0 THEN 50 ELSE 100 END) END AS site FROM customer) SELECT CASE WHEN site IS NULL THEN 'no_overlay' WHEN website = '' THEN 'new' WHEN website = site THEN 'same' ELSE 'differs' END AS vs_master, count(*) AS n FROM m GROUP BY 1",
    "latest_pick_per_key": PICKS.format("c DESC, run_date DESC, run_id DESC"),
    "latest_pick_by_recency": PICKS.format("run_date DESC, run_id DESC, c DESC"),
    "span_overlap": SPANS + "SELECT a.page, a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.page = b.page AND a.start < a.stop AND a.start < b.stop AND b.start < a.stop",
    "span_anti": SPANS + "SELECT page, id, start, stop AS \"end\" FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.page = b.page AND a.start < a.stop AND a.start < b.stop AND b.start < a.stop)",
    "host_ownership": "WITH h AS (SELECT 'h' || (s_suppkey % 37) AS host, list(s_suppkey) AS owners FROM supplier GROUP BY 1) SELECT CASE WHEN owners IS NULL THEN 'unknown' WHEN list_contains(owners, l_suppkey) THEN 'own' ELSE 'other' END AS owner, count(*) AS n FROM lineitem LEFT JOIN h ON host = 'h' || (l_partkey % 45) GROUP BY 1",
    "parent_chain": "WITH n AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS up FROM nation), r AS (SELECT 'r' || r_regionkey AS node FROM region) SELECT node, node AS ancestor, 0 AS depth FROM n UNION ALL SELECT node, node, 0 FROM r UNION ALL SELECT node, up, 1 FROM n UNION ALL SELECT node, 'world', 1 FROM r UNION ALL SELECT node, 'world', 2 FROM n",
    "clique_groups": "SELECT doc_id AS node, CASE WHEN doc_id % 30 <= 2 THEN doc_id - doc_id % 30 ELSE doc_id END AS root FROM documents",
    "never_inspected_pools": "SELECT c_mktsegment, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS never, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS again FROM customer GROUP BY 1",
    "inspection_snapshot": "WITH o AS (SELECT * FROM orders WHERE o_orderkey % 9 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS nth FROM o) SELECT o_custkey AS uid, strftime(max(o_orderdate), '%Y-%m-%d') AS last_inspected_at, 'run' || any_value(o_orderkey) FILTER (nth = 1) AS last_run_id, count(*) AS n_sweeps FROM r GROUP BY 1",
    "frame_composition": "SELECT 'c_mktsegment' AS dimension, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2",
    "largest_remainder": "WITH w AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT c_nationkey, 317 * n / sum(n) OVER () AS x FROM w), b AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, c_nationkey) AS nth, 317 - sum(floor(x)) OVER () AS spare FROM e) SELECT c_nationkey, CAST(f + CASE WHEN nth <= spare THEN 1 ELSE 0 END AS BIGINT) AS share FROM b",
    "uniform_draw": f"SELECT c_custkey, CAST(row_number() OVER (ORDER BY u, c_custkey) AS INTEGER) AS draw_pos FROM (SELECT c_custkey, {_CUST_U.format(seed=7)} AS u FROM customer) QUALIFY draw_pos <= 100",
    "quota_draw": f"""WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT *, 79 * n AS part, sum(n) OVER () AS whole FROM n WHERE c_mktsegment <> 'MACHINERY'),
      b AS (SELECT *, part // whole AS base, row_number() OVER (ORDER BY part % whole DESC, c_mktsegment) AS nth, 79 - sum(part // whole) OVER () AS spare FROM f),
      t AS (SELECT c_mktsegment, base + CASE WHEN nth <= spare THEN 1 ELSE 0 END AS target FROM b UNION ALL SELECT 'MACHINERY', 11),
      r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_CUST_U.format(seed=5)}, c_custkey) AS pos FROM customer)
      SELECT c_custkey, c_mktsegment FROM r JOIN t USING (c_mktsegment) WHERE pos <= target""",
    "weighted_draw": f"SELECT c_custkey, CAST(row_number() OVER (ORDER BY ln(u) / greatest(w, 3600.0) DESC, c_custkey) AS INTEGER) AS draw_pos FROM (SELECT c_custkey, c_acctbal * 1000 AS w, {_CUST_U.format(seed=7)} AS u FROM customer) QUALIFY draw_pos <= 100",
    "stratified_sample": f"WITH u AS (SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_CUST_U.format(seed=3)}, c_custkey) AS INTEGER) AS round FROM customer) SELECT * FROM u ORDER BY round, md5('3|' || c_mktsegment) LIMIT 53",
    "combine_priority": ANSWERS + f", p AS (SELECT unit, min_by(entered, list_position({list(ORDER)}, entered)) AS value FROM v WHERE covered GROUP BY 1) " + _PICKED,
    "combine_any_yes": ANSWERS.replace("GROUP BY 1, 2), v AS", "GROUP BY 1, 2 HAVING value NOT IN ('pilot', 'live')), v AS") + ", p AS (SELECT unit, min_by(entered, list_position(['yes', 'no', 'not_documented', 'unknown'], entered)) AS value FROM v WHERE covered GROUP BY 1) " + _PICKED,
    "combine_first_section": ANSWERS + ", p AS (SELECT unit, min_by(entered, part) AS value FROM v WHERE is_real GROUP BY 1) " + _PICKED,
    "combine_earliest": ANSWERS.replace("GROUP BY 1, 2), v AS", "GROUP BY 1, 2 HAVING value <> 'no'), v AS") + ", p AS (SELECT unit, CAST(min(2010 + unit * part % 20) AS VARCHAR) AS value FROM v WHERE is_real GROUP BY 1) " + _PICKED,
    "combine_highest": ANSWERS + ", p AS (SELECT DISTINCT ON (unit) unit, entered AS value FROM v WHERE is_real ORDER BY unit, probability DESC, part) " + _PICKED,
    "combine_list": ANSWERS + ", l AS (SELECT unit, list(entered ORDER BY part) AS l FROM v WHERE is_real GROUP BY 1), p AS (SELECT unit, CASE WHEN list_contains(l, 'pilot') AND list_contains(l, 'live') THEN 'both' ELSE array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') END AS value FROM l) " + _PICKED,
    "confidence_quorum": "WITH c AS (SELECT l_orderkey AS activity, ['low', 'medium', 'unknown', 'low', 'medium', 'low', 'low', 'high'][CAST((l_partkey + l_suppkey) % 8 AS INT) + 1] AS c, l_suppkey % 3 AS g FROM lineitem) SELECT activity, CASE WHEN bool_or(c = 'high') OR count(DISTINCT g) FILTER (c = 'medium') >= 2 THEN 'high' WHEN bool_or(c = 'medium') THEN 'medium' ELSE 'low' END AS confidence FROM c GROUP BY 1",
    "best_confidence": "WITH c AS (SELECT l_orderkey AS unit, ['low', 'medium', 'unknown', 'low', 'medium', 'low', 'low', 'high'][CAST((l_partkey + l_suppkey) % 8 AS INT) + 1] AS c FROM lineitem) SELECT unit, arg_max(c, CASE c WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS confidence FROM c GROUP BY 1",
    "flags_union": "WITH f AS (SELECT l_orderkey, unnest(CASE WHEN l_linenumber % 3 = 0 THEN [NULL] ELSE [lower(l_returnflag), lower(l_linestatus)] END) AS f FROM lineitem) SELECT l_orderkey, coalesce(string_agg(DISTINCT f, ';' ORDER BY f), 'none') AS flags FROM f GROUP BY 1",
    "group_d_salvage": CODED + ", m AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {f} = '_NA_' THEN '{f}' END" for f in FIELDS) + "], lambda x: x IS NOT NULL) AS na, genai_evidence = 'confirms_activity' AS yes FROM c), n AS (SELECT *, yes AND NOT list_contains(na, 'activity_name') AS fix FROM m) SELECT o_orderkey, " + ", ".join(f"CASE WHEN fix AND {f} = '_NA_' THEN '{_DEF[f]}' ELSE {f} END AS {f}" for f in FIELDS) + ", CASE WHEN fix THEN array_to_string(na, ',') ELSE '' END AS salvaged, CASE WHEN yes AND list_contains(na, 'activity_name') THEN 'activity_name' ELSE '' END AS stuck FROM n",
    "negative_row_salvage": CODED + ", k AS (SELECT * REPLACE ('_NA_' AS activity_name, CASE WHEN o_orderkey % 3 <> 0 THEN '_NA_' ELSE tool_name END AS tool_name) FROM c), m AS (SELECT *, genai_evidence <> 'confirms_activity' AS neg, list_filter([" + ", ".join(f"CASE WHEN {f} <> '_NA_' THEN '{f}' END" for f in FIELDS) + "], lambda x: x IS NOT NULL) AS s FROM k) SELECT genai_evidence, CASE WHEN neg AND NOT list_contains(s, 'tool_name') THEN array_to_string(s, ',') ELSE '' END AS blanked, CASE WHEN neg AND list_contains(s, 'tool_name') THEN 'tool_name' ELSE '' END AS against, count(*) AS n, count(*) FILTER (adoption_stage = '_NA_' OR neg AND NOT list_contains(s, 'tool_name')) AS n_na FROM m GROUP BY 1, 2, 3",
    "flags_salvage": "WITH f AS (SELECT ['a;b', 'none', 'none', 'none', 'x;_NA_', 'none'][CAST(o_orderkey % 6 AS INT) + 1] AS flags FROM orders) SELECT flags, count(*) AS n FROM f GROUP BY 1",
    "contract_violations": "WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS key, unnest([CASE WHEN l_quantity NOT BETWEEN 2 AND 49 THEN 'quantity_range' END, CASE WHEN l_discount > 0.09 THEN 'discount_cap' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'flag_status' END, CASE WHEN year(l_shipdate) >= 2001 THEN 'ship_late' END]) AS code FROM lineitem) SELECT code, count(*) AS n, min(key) AS least FROM v WHERE code IS NOT NULL GROUP BY 1",
    "cross_row_consistency": "WITH c AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b FROM lineitem GROUP BY 1) SELECT 'l_returnflag' AS field, count(*) AS n FROM c WHERE a > 1 UNION ALL SELECT 'l_linestatus', count(*) FROM c WHERE b > 1",
    "vocabulary_errors": "SELECT o_orderkey AS key, 'v1' AS version, o_orderstatus AS value FROM orders WHERE year(o_orderdate) < 1998 AND o_orderstatus NOT IN ('F', 'O')",
    "version_steps": "WITH l AS (SELECT l_partkey AS item, CAST(year(l_shipdate) AS INTEGER) AS release, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS v, count(*) % 3 AS label FROM lineitem GROUP BY 1, 2), w AS (SELECT *, lag(v) OVER (PARTITION BY item ORDER BY release) AS pv, lag(label) OVER (PARTITION BY item ORDER BY release) AS pl FROM l) SELECT item, release FROM w WHERE pv <> v AND pl = label",
    "run_state_fold": LOG + ", r AS (SELECT run_id, max(seq) FILTER (event IN ('completed', 'stopped', 'failed')) AS t, arg_max(event, seq) FILTER (event IN ('completed', 'stopped', 'failed')) AS e, max(seq) FILTER (event = 'resumed') AS back FROM l GROUP BY 1), s AS (SELECT run_id, stage, max(seq) FILTER (event = 'stage_started') AS a, max(seq) FILTER (event = 'stage_completed') AS z FROM l WHERE stage IS NOT NULL GROUP BY 1, 2), f AS (SELECT run_id, arg_max(stage, a) AS stage FROM s WHERE a IS NOT NULL AND (z IS NULL OR z < a) GROUP BY 1), q AS (SELECT run_id, CASE WHEN t IS NULL OR back > t THEN 'running' ELSE e END AS status FROM r) SELECT q.run_id, status, CASE WHEN status = 'running' THEN stage END AS stage_in_flight FROM q LEFT JOIN f ON f.run_id = q.run_id",
    "running_spend": LOG + ", s AS (SELECT run_id, stage, seq, round(sum(units) OVER (PARTITION BY run_id, stage ORDER BY seq), 4) AS spent FROM l WHERE stage IS NOT NULL) SELECT run_id, stage, max(spent) AS spent, min(seq) FILTER (spent > 80) AS first_over FROM s GROUP BY 1, 2",
    "spend_totals": LOG + "SELECT stage, round(sum(units), 4) AS units, count(*) AS n FROM l WHERE stage IS NOT NULL GROUP BY 1",
    "ledger_dedup": LOG + "SELECT DISTINCT run_id, event, coalesce(stage, '-') AS stage FROM l",
    "host_breaker": LOG + ", i AS (SELECT host, seq, ok, count(*) FILTER (ok) OVER (PARTITION BY host ORDER BY seq) AS island FROM l), f AS (SELECT host, seq, count(*) FILTER (NOT ok) OVER (PARTITION BY host, island ORDER BY seq) AS failures FROM i) SELECT host, seq, failures, bool_or(failures >= 3) OVER (PARTITION BY host ORDER BY seq) AS is_open FROM f",
    "throttle_gaps": LOG + ", g AS (SELECT host, seq, round(sec - lag(sec) OVER (PARTITION BY host ORDER BY sec, seq), 6) AS gap FROM l) SELECT host, seq, gap FROM g WHERE gap < 200",
}
