"""Queries on run records: reconciling, journals, usage, languages, links, quotes, pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs
from ..session import table
from .fixtures import ctes, rows

MANIFESTS = "SELECT n_nationkey AS run_id, 2 AS layout_version, n_regionkey AS region, n_name FROM {nation}"


def layout_gate(spark, sf):
    return runs.require_layout(rows(spark, sf, MANIFESTS), 2).groupBy("layout_version").agg(F.count(F.lit(1)).alias("n"))


def manifest_uids(spark, sf):
    m = rows(spark, sf, MANIFESTS).select("run_id", F.create_map(F.concat(F.lit("i"), "region"), F.concat(F.lit("u"), "run_id"), F.lit("own"), F.col("n_name")).alias("uids"))
    return runs.uid_map(m)


FILES = "SELECT 'run' || (o_custkey % 50) AS run_id, 'rows_v' || (o_orderkey % 4) || '.csv' AS path FROM {orders} UNION SELECT 'run' || (o_custkey % 50), 'sums_v' || (o_orderkey % 3) || '.csv' FROM {orders} UNION SELECT 'run1', 'notes.txt' FROM {region}"


def latest_outputs(spark, sf):
    return runs.latest_version(rows(spark, sf, FILES))


KEYS = "SELECT CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'u' || (o_custkey % 90) END AS uid, CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE 'i' || (o_custkey % 70) END AS id FROM {orders}"


def run_institution_keys(spark, sf):
    return runs.institution_keys(rows(spark, sf, KEYS))


PLANNED = "SELECT o_orderkey AS custom_id FROM {orders} WHERE o_orderkey % 9 <> 0"
OBSERVED = "SELECT l_orderkey AS custom_id FROM {lineitem} WHERE l_linenumber < 3 AND l_orderkey % 7 <> 0"


def batch_reconciliation(spark, sf):
    return runs.reconcile(rows(spark, sf, PLANNED), rows(spark, sf, OBSERVED))


LEFT = "SELECT o_orderkey % 40 AS k, o_orderstatus AS s FROM {orders} WHERE o_orderkey % 3 <> 0"
RIGHT = "SELECT o_orderkey % 40 AS k, o_orderstatus AS s FROM {orders} WHERE o_orderkey % 4 <> 0"


def multiset_difference(spark, sf):
    return runs.both_ways(rows(spark, sf, LEFT), rows(spark, sf, RIGHT)).groupBy("side", "k", "s").agg(F.count(F.lit(1)).alias("n"))


def sequence_difference(spark, sf):
    return runs.same_sequence(rows(spark, sf, "SELECT o_orderkey AS pos, o_orderstatus AS v FROM {orders}"), rows(spark, sf, "SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 50 = 0 THEN 'x' ELSE o_orderstatus END AS v FROM {orders} WHERE o_orderkey % 71 <> 0"), "pos", "v")


RECORDS = "SELECT event_id, user_id AS inst, 'k' || (event_id % 300) AS url_key FROM {events}"
DECISIONS = "SELECT user_id AS inst, 'k' || (event_id % 300) AS url_key, CASE WHEN event_id % 4 = 0 THEN 'drop' ELSE 'pass' END AS decision FROM {events} WHERE event_type <> 'view'"


def pruned_records(spark, sf):
    return runs.pruned(rows(spark, sf, RECORDS), rows(spark, sf, DECISIONS), ["inst", "url_key"])


def fallback_institutions(spark, sf):
    sites = rows(spark, sf, "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'u' END AS url FROM {customer} WHERE c_custkey % 5 <> 0")
    return runs.needs_fallback(rows(spark, sf, "SELECT c_custkey FROM {customer}"), sites, "c_custkey")


def needed_tasks(spark, sf):
    tasks = rows(spark, sf, "SELECT l_orderkey, l_linenumber, l_returnflag FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_returnflag")
    done = rows(spark, sf, "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_suppkey % 2 = 0")
    return runs.still_needed(tasks, done, ["l_orderkey", "l_linenumber"], F.when(F.col("l_returnflag") == "R", "page_rejected"))


STATUSES = "SELECT event_type AS run_id, user_id % 60 AS institution, min('c' || (event_id % 3)) AS code FROM {events} GROUP BY event_type, user_id % 60"


def final_status_tallies(spark, sf):
    return runs.status_tallies(rows(spark, sf, STATUSES))


CALLS = "SELECT event_type AS stage, user_id AS request, event_id % 100 AS tokens FROM {events}"


def journal_usage(spark, sf):
    return runs.usage_totals(rows(spark, sf, CALLS), ["stage"])


LOG = "SELECT event_type AS run_id, event_id AS seq, event_id * 3 % 1000 AS at, 'e' || (event_id % 5) AS event FROM {events}"


def run_sequences(spark, sf):
    return runs.last_seq(rows(spark, sf, LOG))


def numbered_events(spark, sf):
    new = rows(spark, sf, LOG).where("seq % 10 = 0").select("run_id", "at", "event")
    return runs.with_seq(new, runs.last_seq(rows(spark, sf, LOG).where("run_id <> 'error'")))


JOURNAL = "SELECT l_orderkey AS request, CASE l_linenumber WHEN 1 THEN 'intent' WHEN 2 THEN 'submitted' WHEN 3 THEN 'collected' ELSE CASE l_suppkey % 5 WHEN 0 THEN 'abandoned' ELSE 'intent' END END AS event FROM {lineitem}"


def journal_states(spark, sf):
    return runs.journal_state(rows(spark, sf, JOURNAL)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def replayed_requests(spark, sf):
    asked = rows(spark, sf, "SELECT o_orderkey AS request, 'ask ' || (o_custkey % 200) AS body FROM {orders}")
    stored = rows(spark, sf, "SELECT 'ask ' || (c_custkey % 120) AS body, c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'answer ' || c_custkey END AS response FROM {customer}").select(F.sha2("body", 256).alias("digest"), "seq", "response")
    return runs.replayed(asked, stored)


def chunk_estimates(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return n.select("o_orderstatus", runs.chunk_estimate(F.col("n"), F.lit(3000), 1_000_000, 500).cast("long").alias("chunks"))


STEPS = "SELECT p_partkey AS a, p_partkey + 1 AS b FROM {part} WHERE p_partkey % 6 <> 0"


def fixpoint_waves(spark, sf):
    edges = rows(spark, sf, STEPS)
    reach, _ = runs.waves(edges, lambda s: s.alias("s").join(edges.alias("e"), F.col("s.b") == F.col("e.a")).select(F.col("s.a").alias("a"), F.col("e.b").alias("b")))
    return reach


ITEMS = "SELECT 'q' || p_partkey AS item, CASE p_partkey % 10 WHEN 3 THEN 'q' || (p_partkey - 1) WHEN 4 THEN 'none' WHEN 5 THEN 'q' || (p_partkey + 1) WHEN 6 THEN 'q' || (p_partkey - 1) END AS gate, p_partkey % 2 + 1 AS pass, p_partkey % 10 AS round FROM {part}"


def gate_faults(spark, sf):
    return runs.gate_faults(rows(spark, sf, ITEMS))


VALUES = "SELECT 'i' || (l_partkey % 20) AS item, CASE l_suppkey % 6 WHEN 0 THEN 'Upper' WHEN 1 THEN 'unknown' WHEN 2 THEN 'a__b' ELSE 'v_' || (l_orderkey % 4000) END AS value FROM {lineitem}"


def vocabulary_faults(spark, sf):
    return runs.vocabulary_faults(rows(spark, sf, VALUES), ("unknown", "not_documented"))


def release_id_changes(spark, sf):
    return runs.id_changes(rows(spark, sf, "SELECT p_partkey AS item FROM {part} WHERE p_partkey % 3 <> 0"), rows(spark, sf, "SELECT p_partkey AS item FROM {part} WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey FROM {part} WHERE p_partkey % 41 = 1"), "item")


TYPED = "SELECT l_orderkey * 10 + l_linenumber AS key, CASE l_linenumber WHEN 1 THEN 'stage' WHEN 2 THEN 'year' WHEN 3 THEN 'count' WHEN 4 THEN 'note' ELSE 'other' END AS item, CASE l_suppkey % 5 WHEN 0 THEN 'pilot' WHEN 1 THEN '2020' WHEN 2 THEN '3' WHEN 3 THEN ' ' ELSE NULL END AS value FROM {lineitem}"


def typed_values(spark, sf):
    rules = spark.createDataFrame([("stage", "code", ["pilot", "live"]), ("year", "year", None), ("count", "integer", None), ("note", "text", None)], "item string, kind string, codes array<string>")
    return runs.typed_violations(rows(spark, sf, TYPED), rules).groupBy("item", "fault").agg(F.count(F.lit(1)).alias("n"))


def pilot_override(spark, sf):
    o = rows(spark, sf, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'pilot' WHEN 1 THEN 'announced' ELSE 'unknown' END AS stage, o_custkey % 4 = 0 AS permanent FROM {orders}")
    return runs.overridden(o, F.col("permanent"), "stage", "production", ("pilot", "announced")).select("o_orderkey", "stage")


def stored_flag_strings(spark, sf):
    o = table(spark, sf, "orders")
    flags = F.when(F.col("o_orderkey") % 3 == 0, F.array()).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("a"), F.lower("o_orderstatus"))).cast("array<string>")
    return o.select("o_orderkey", runs.stored_flags(flags).alias("flags"))


FOUND = "SELECT event_id, event_type AS language, event_id % 3 AS k FROM {events}"


def record_languages(spark, sf):
    r = rows(spark, sf, FOUND)
    found = F.when(F.col("k") == 0, F.array(F.struct(F.lit("q").alias("query"), F.lit("fr").alias("language")), F.struct(F.lit("r").alias("query"), F.lit("en").alias("language")), F.struct(F.lit("s").alias("query"), F.lit("").alias("language"))))
    return r.select("event_id", F.array_join(runs.record_languages(found, F.when(F.col("k") == 1, F.col("language"))), ",").alias("languages"))


def policy_languages(spark, sf):
    policy = table(spark, sf, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("fr"), F.lit("de"))).otherwise(F.array(F.lit("en"), F.lit("es"))).alias("languages"))
    out = runs.policy_languages(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), policy, ["pt"], ["en"], "c_nationkey")
    return out.select("c_custkey", runs.languages_string(F.col("languages"), "it").alias("languages"), "used_fallback")


def language_queries(spark, sf):
    i = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name", F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("en"), F.lit("fr"), F.lit("en"))).otherwise(F.array(F.lit("de"), F.lit("xx"))).alias("languages"))
    roster = spark.createDataFrame([("en", "generative AI"), ("fr", "IA"), ("de", "")], "language string, terms string")
    return runs.queries_by_language(i, roster, "c_name", True)


def model_prices(spark, sf):
    models = rows(spark, sf, "SELECT DISTINCT CASE event_id % 5 WHEN 0 THEN 'm-small' WHEN 1 THEN 'm-small-2025-08-07' WHEN 2 THEN 'm-small-turbo' WHEN 3 THEN 'm-2025-01-01' ELSE 'm-x-' || event_type END AS model FROM {events}")
    return runs.priced_models(models, spark.createDataFrame([("m-small", 1.5), ("m", 2.0), ("m-2025-01-01", 9.0)], "model string, price double"))


def log_counts(spark, sf):
    logs = rows(spark, sf, "SELECT o_orderkey, 'loaded ' || (o_orderkey % 9) || ',' || '012 rows; bad: ' || (o_custkey % 5) AS line FROM {orders}")
    return logs.select("o_orderkey", runs.counts_from_log(F.col("line"), {"loaded": r"loaded ([0-9,]+)", "bad": r"bad: (\d+)", "gone": r"gone: (\d+)"}).alias("c")).select("o_orderkey", "c.*")


DATED = "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '2020-05' END AS published, CASE o_orderkey % 5 WHEN 0 THEN '2031' WHEN 1 THEN 'n' ELSE '2019' END AS stated, '2024-02-03' AS accessed FROM {orders}"


def observation_dates(spark, sf):
    d = rows(spark, sf, DATED)
    return d.select("o_orderkey", runs.stage_as_of(F.col("published"), F.col("stated"), F.col("accessed")).alias("as_of"), runs.is_future_year(F.col("stated"), F.col("accessed")).alias("future"))


def iso_instants(spark, sf):
    e = rows(spark, sf, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '2024-05-06T07:08:09Z' WHEN 1 THEN '2024-05-06T07:08:09+02:00' ELSE '2024-05-06' END AS v FROM {events}")
    return e.select("event_id", F.unix_timestamp(runs.instant(F.col("v"))).alias("epoch"))


#: Quotes: the words 4 to 8 of each document, and the same with other capitals and white space.
def quote_spans(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text", F.regexp_extract("text", r"^(?:\S+ ){3}(\S+ \S+ \S+)", 1).alias("quote"))
    exact, loose = runs.located(F.col("quote"), F.col("text")), runs.located(F.replace(F.translate("quote", "abcdefghijklmnop", "ABCDEFGHIJKLMNOP"), F.lit(" "), F.lit("\n ")), F.col("text"))
    return d.select("doc_id", exact["start"].alias("start"), exact["end"].alias("end"), loose.isNotNull().alias("loose"))


def anchored_spans(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    found = runs.anchored_span(F.col("text"), F.lit("the "), F.lit("."))
    return d.select("doc_id", found.alias("s")).select("doc_id", "s.*")


SPANS = "SELECT user_id % 400 AS page, event_id AS id, event_id * 7 % 5000 AS start, event_id * 7 % 5000 + event_id % 30 + 1 AS stop, event_type FROM {events}"


def _spans(spark, sf):
    return rows(spark, sf, SPANS).withColumnRenamed("stop", "end")


def link_nearness(spark, sf):
    s = _spans(spark, sf)
    return runs.nearness(s.where("event_type = 'error'").withColumnRenamed("id", "link"), s.where("event_type = 'purchase'"))


def activity_pairs(spark, sf):
    return runs.span_pairs(_spans(spark, sf).where("event_type = 'error'"))


POOL = "SELECT o_custkey AS pool, 'e' || o_orderkey AS entry_id, o_orderkey % 4 AS page_order, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE '20' || (10 + o_orderkey % 13) END AS source_date FROM {orders}"


def pool_positions(spark, sf):
    return runs.in_pool_order(rows(spark, sf, POOL)).select("pool", "entry_id", "position")


def pool_positions_undated_first(spark, sf):
    return runs.in_pool_order(rows(spark, sf, POOL), "first").select("pool", "entry_id", "position")


def scrape_work_list(spark, sf):
    u = rows(spark, sf, "SELECT o_custkey AS institution, 'u' || (l_partkey % 90) AS url, l_orderkey * 10 + l_linenumber AS rank FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey")
    return runs.work_list(u, 5).select("institution", F.array_join("urls", "|").alias("urls"))


OVERLAY = "SELECT CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'u' || c_custkey END AS uid, CASE c_custkey % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'medium ' WHEN 2 THEN 'low' END AS confidence, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'https://h' || c_custkey || '/' END AS site_root, c_custkey % 5 AS n_sharing FROM {customer}"


def bypass_sites(spark, sf):
    return runs.bypass_sites(rows(spark, sf, OVERLAY))


CANDIDATES = "SELECT o_custkey AS institution, o_orderkey AS position, 'u' || o_orderkey AS url, CASE o_orderkey % 6 WHEN 0 THEN NULL ELSE (o_orderkey % 5) / 4.0 END AS probability FROM {orders}"


def likeliest_site(spark, sf):
    return runs.best_candidate(rows(spark, sf, CANDIDATES).withColumn("probability", F.col("probability").cast("double")))


MENTIONS = "SELECT o_custkey AS scope, o_orderkey AS id, 'n' || (o_orderkey % 4) AS name FROM {orders}"


def name_groups(spark, sf):
    pairs = rows(spark, sf, "SELECT o_custkey AS scope, o_orderkey AS a, o_orderkey AS b, 0.9 AS probability FROM {orders}")
    return runs.linked_groups(rows(spark, sf, MENTIONS), pairs)


def kept_page_artifacts(spark, sf):
    a = table(spark, sf, "pages").select(F.md5("url").alias("stem"), "page_id")
    return runs.kept_artifacts(a, table(spark, sf, "pages").where("page_id % 3 = 0").select("url")).select("page_id")


def publishable_rows(spark, sf):
    a = rows(spark, sf, "SELECT c_custkey AS uid, 'f' || (c_custkey % 3) AS file, 'N' || c_nationkey AS country, c_mktsegment AS level, c_custkey % 4 <> 0 AS attributed FROM {customer}")
    b = rows(spark, sf, "SELECT DISTINCT 'f' || (c_custkey % 3) AS file, 'N' || c_nationkey AS country, c_mktsegment AS level, 'b' || c_nationkey AS block, c_nationkey % 2 = 0 AS allowed FROM {customer} WHERE c_nationkey % 5 <> 0")
    return runs.publishable(a, b)


def text_length_shares(spark, sf):
    return runs.length_shares(table(spark, sf, "documents").select(F.length("text").alias("n")), "n", (500, 2000, 8000))


def label_cutoffs(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return runs.cutoff_table(d, "n_chars", "quality", (500, 1000, 2000, 4000))


def tuned_cutoff(spark, sf):
    return runs.best_cutoff(label_cutoffs(spark, sf))


def preflight_estimate(spark, sf):
    s = rows(spark, sf, "SELECT user_id AS institution, event_type AS stage, event_id % 4 AS credits, event_id % 3 AS jobs, event_id % 1000 AS tokens FROM {events}")
    return runs.preflight(s, 10_000, 0.001, 0.000002)


def resumed_spend(spark, sf):
    prior = spark.createDataFrame([("view", 10.5), ("other", 3.0)], "api string, units double")
    return runs.seeded_totals(prior, rows(spark, sf, "SELECT event_type AS api, CAST(event_id % 7 AS DOUBLE) AS units FROM {events}"))


def robots_rules(spark, sf):
    u = rows(spark, sf, "SELECT event_id AS id, 'h' || (user_id % 6) AS host, CASE event_id % 4 WHEN 0 THEN '/a/b/c' WHEN 1 THEN '/a/x' WHEN 2 THEN '/z' ELSE '/' END AS url_path FROM {events}")
    r = spark.createDataFrame([("h1", "/a", False), ("h1", "/a/b", True), ("h2", "/", False), ("h3", "/z", False), ("h3", "/z", True)], "host string, path string, allow boolean")
    return runs.allowed_by_robots(u, r)


def run_liveness(spark, sf):
    return runs.liveness(rows(spark, sf, "SELECT user_id AS run_id, event_id * 13 % 5000 AS at FROM {events}"), F.lit(5000), 300.0)


def checked_codes(spark, sf):
    li = rows(spark, sf, "SELECT l_partkey % 3 <> 0 AS present, CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS entailed, l_discount * 10 AS p FROM {lineitem}")
    c = runs.checked_code(F.col("present"), F.col("entailed"), F.col("p"))
    return li.select(c["status"].alias("status"), c["second"].alias("second")).groupBy("status", "second").agg(F.count(F.lit(1)).alias("n"))


def extract_jobs(spark, sf):
    p = table(spark, sf, "documents").select((F.col("doc_id") % 30).alias("institution"), F.concat(F.lit("u"), "doc_id").alias("url"), "text")
    return runs.extract_jobs(p, "b1", 200, 500).select("custom_id", "institution", F.length("text").alias("n"))


def page_artifacts(spark, sf):
    parts = table(spark, sf, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return runs.page_artifact(parts).select("page", F.md5("text").alias("md5"), "segments")


def kept_identity(spark, sf):
    old = rows(spark, sf, "SELECT c_custkey AS id, 'first ' || c_name AS launched FROM {customer} WHERE c_custkey % 3 = 0")
    return runs.preserved_identity(old, rows(spark, sf, "SELECT c_custkey AS id, c_name AS launched, c_nationkey FROM {customer}"), "id", ["launched"])


QUERIES = {
    f.__name__: f
    for f in (
        layout_gate, manifest_uids, latest_outputs, run_institution_keys, batch_reconciliation, multiset_difference, sequence_difference, pruned_records, fallback_institutions, needed_tasks,
        final_status_tallies, journal_usage, run_sequences, numbered_events, journal_states, replayed_requests, chunk_estimates, fixpoint_waves, gate_faults, vocabulary_faults, release_id_changes,
        typed_values, pilot_override, stored_flag_strings, record_languages, policy_languages, language_queries, model_prices, log_counts, observation_dates, iso_instants, quote_spans, anchored_spans,
        link_nearness, activity_pairs, pool_positions, pool_positions_undated_first, scrape_work_list, bypass_sites, likeliest_site, name_groups, kept_page_artifacts, publishable_rows,
        text_length_shares, label_cutoffs, tuned_cutoff, preflight_estimate, resumed_spend, robots_rules, run_liveness, checked_codes, extract_jobs, page_artifacts, kept_identity,
    )
}

_CUT = "SELECT CAST(c AS INTEGER) AS cutoff, count(*) FILTER (n_chars >= c AND quality = 1) AS tp, count(*) FILTER (n_chars >= c AND quality <> 1) AS fp, count(*) FILTER (n_chars < c AND quality = 1) AS fn, count(*) FILTER (n_chars < c AND quality <> 1) AS tn, count(*) FILTER (n_chars >= c AND quality <> 1) + count(*) FILTER (n_chars < c AND quality = 1) AS errors FROM documents JOIN labels USING (doc_id) CROSS JOIN (VALUES (500), (1000), (2000), (4000)) v(c) GROUP BY 1"
_POOL = ctes(p=POOL) + "SELECT pool, entry_id, CAST(row_number() OVER (PARTITION BY pool ORDER BY {} nullif(source_date, ''), page_order, entry_id) AS INTEGER) AS position FROM p"
ORACLES = {
    "layout_gate": "SELECT CAST(2 AS INTEGER) AS layout_version, count(*) AS n FROM nation",
    "manifest_uids": "SELECT n_nationkey AS run_id, 'i' || n_regionkey AS institution_id, 'u' || n_nationkey AS uid FROM nation UNION ALL SELECT n_nationkey, 'own', n_name FROM nation",
    "latest_outputs": ctes(f=FILES) + r", v AS (SELECT run_id, path, CAST(nullif(regexp_extract(path, '_v([0-9]+)\.csv$', 1), '') AS INTEGER) AS version FROM f), m AS (SELECT run_id, max(version) AS version FROM v GROUP BY 1) SELECT run_id, version, string_agg(path, '|' ORDER BY path) AS files FROM v JOIN m USING (run_id, version) GROUP BY 1, 2",
    "run_institution_keys": ctes(k=KEYS) + "SELECT DISTINCT coalesce(nullif(uid, ''), id) AS key, CASE WHEN nullif(uid, '') IS NOT NULL THEN 'uid' ELSE 'id' END AS key_column FROM k WHERE coalesce(nullif(uid, ''), id) IS NOT NULL",
    "batch_reconciliation": ctes(p=PLANNED, o=OBSERVED) + "SELECT custom_id, 'missing' AS status FROM p WHERE custom_id NOT IN (SELECT custom_id FROM o) UNION ALL SELECT DISTINCT custom_id, 'extra' FROM o WHERE custom_id NOT IN (SELECT custom_id FROM p) UNION ALL SELECT custom_id, 'duplicate' FROM o GROUP BY 1 HAVING count(*) > 1",
    "multiset_difference": ctes(a=LEFT, b=RIGHT) + ", l AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), r AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a) SELECT 'left' AS side, k, s, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 'right', k, s, count(*) FROM r GROUP BY ALL",
    "sequence_difference": "SELECT o_orderkey AS pos, o_orderstatus AS left_value, CASE WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN 'x' ELSE o_orderstatus END AS right_value FROM orders WHERE o_orderkey % 71 = 0 OR o_orderkey % 50 = 0",
    "pruned_records": ctes(r=RECORDS, d=DECISIONS) + ", g AS (SELECT inst, url_key FROM d GROUP BY 1, 2 HAVING bool_and(decision = 'drop')) SELECT r.* FROM r ANTI JOIN g ON r.inst = g.inst AND r.url_key = g.url_key",
    "fallback_institutions": "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 4 < 2",
    "needed_tasks": "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'R' THEN 'page_rejected' END AS rejected FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_suppkey % 2 = 0)",
    "final_status_tallies": ctes(s=STATUSES) + ", a AS (SELECT institution, count(DISTINCT code) > 1 AS apart FROM s GROUP BY 1) SELECT run_id, code, count(*) AS n, count(*) FILTER (apart) AS divergent FROM s JOIN a USING (institution) GROUP BY 1, 2",
    "journal_usage": ctes(c=CALLS) + ", o AS (SELECT stage, request, max(tokens) AS tokens FROM c GROUP BY 1, 2) SELECT stage, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM o GROUP BY 1",
    "run_sequences": ctes(l=LOG.replace(" AS at", " AS sec")) + "SELECT run_id, max(seq) AS last_seq, max(sec) - min(sec) AS elapsed FROM l GROUP BY 1",
    "numbered_events": ctes(l=LOG.replace(" AS at", " AS sec")) + ", k AS (SELECT run_id, max(seq) AS last_seq FROM l WHERE run_id <> 'error' GROUP BY 1) SELECT l.run_id, coalesce(last_seq, 0) + row_number() OVER (PARTITION BY l.run_id ORDER BY sec, event) AS seq, sec AS \"at\", event FROM l LEFT JOIN k USING (run_id) WHERE seq % 10 = 0",
    "journal_states": ctes(j=JOURNAL) + ", s AS (SELECT request, CASE WHEN bool_or(event = 'collected') THEN 'collected' WHEN bool_or(event = 'abandoned') THEN 'abandoned' WHEN bool_or(event = 'submitted') THEN 'submitted' ELSE 'intent' END AS state FROM j GROUP BY 1) SELECT state, count(*) AS n FROM s GROUP BY 1",
    "replayed_requests": "WITH s AS (SELECT 'ask ' || (c_custkey % 120) AS body, arg_min('answer ' || c_custkey, c_custkey) AS response FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1) SELECT o_orderkey AS request, 'ask ' || (o_custkey % 200) AS body, response, response IS NULL AS to_send FROM orders LEFT JOIN s ON s.body = 'ask ' || (o_custkey % 200)",
    "chunk_estimates": "SELECT o_orderstatus, CAST(greatest(ceil(count(*) * 3000 / 1000000), ceil(count(*) / 500)) AS BIGINT) AS chunks FROM orders GROUP BY 1",
    "fixpoint_waves": ctes(e=STEPS) + "SELECT a, b FROM (SELECT a, unnest(range(a + 1, a - a % 6 + 7)) AS b FROM e) WHERE b - 1 IN (SELECT a FROM e)",
    "vocabulary_faults": ctes(v=VALUES) + ", c AS (SELECT item, value, count(*) AS n FROM v GROUP BY 1, 2), f AS (SELECT item, value, unnest([CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN NOT regexp_full_match(value, '[a-z0-9]+(_[a-z0-9]+)*') THEN 'not_snake_case' END, CASE WHEN value = 'unknown' THEN 'missing_token' END]) AS fault FROM c) SELECT * FROM f WHERE fault IS NOT NULL",
    "release_id_changes": "SELECT p_partkey AS item, 'removed' AS fault FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 = 0 AND p_partkey % 41 <> 1 UNION ALL SELECT p_partkey, 'repeated' FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 41 = 1",
    "typed_values": ctes(t=TYPED) + ", f AS (SELECT item, CASE item WHEN 'other' THEN 'unknown_item' WHEN 'stage' THEN CASE WHEN coalesce(value, '') NOT IN ('pilot', 'live') THEN 'not_a_code' END WHEN 'count' THEN CASE WHEN TRY_CAST(nullif(trim(value), '') AS BIGINT) IS NULL THEN 'not_a_number' END WHEN 'year' THEN CASE WHEN coalesce(value, '') <> '2020' THEN 'not_a_year' END WHEN 'note' THEN CASE WHEN trim(coalesce(value, '')) = '' THEN 'empty' END END AS fault FROM t) SELECT item, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1, 2",
    "pilot_override": "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 3 < 2 THEN 'production' ELSE ['pilot', 'announced', 'unknown'][CAST(o_orderkey % 3 + 1 AS INT)] END AS stage FROM orders",
    "stored_flag_strings": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN 'a;' || lower(o_orderstatus) ELSE 'none' END AS flags FROM orders",
    "record_languages": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'en,fr' WHEN 1 THEN event_type ELSE '' END AS languages FROM events",
    "policy_languages": "SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'it,en,pt' WHEN 1 THEN 'it,en,fr,de' ELSE 'it,en,es' END AS languages, c_nationkey % 3 = 0 AS used_fallback FROM customer",
    "language_queries": "SELECT c_custkey AS key, l AS language, '\"' || c_name || '\"' || t AS query FROM customer JOIN (VALUES ('en', ' generative AI', 0), ('fr', ' IA', 0), ('de', '', 1)) r(l, t, k) ON c_custkey % 2 = k",
    "model_prices": "WITH m AS (SELECT DISTINCT CASE event_id % 5 WHEN 0 THEN 'm-small' WHEN 1 THEN 'm-small-2025-08-07' WHEN 2 THEN 'm-small-turbo' WHEN 3 THEN 'm-2025-01-01' ELSE 'm-x-' || event_type END AS model FROM events) SELECT model, CASE model WHEN 'm-small' THEN 'm-small' WHEN 'm-small-2025-08-07' THEN 'm-small' WHEN 'm-2025-01-01' THEN model END AS base, CASE model WHEN 'm-small' THEN 1.5::DOUBLE WHEN 'm-small-2025-08-07' THEN 1.5 WHEN 'm-2025-01-01' THEN 9.0 END AS price FROM m",
    "log_counts": "SELECT o_orderkey, o_orderkey % 9 * 1000 + 12 AS loaded, o_custkey % 5 AS bad, CAST(NULL AS BIGINT) AS gone FROM orders",
    "observation_dates": ctes(d=DATED) + "SELECT o_orderkey, coalesce(published, CASE WHEN TRY_CAST(stated AS INTEGER) <= 2024 THEN stated END, accessed) AS as_of, TRY_CAST(stated AS INTEGER) > 2024 AS future FROM d",
    "iso_instants": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(epoch(TIMESTAMP '2024-05-06 07:08:09') AS BIGINT) WHEN 1 THEN CAST(epoch(TIMESTAMP '2024-05-06 05:08:09') AS BIGINT) END AS epoch FROM events",
    "quote_spans": r"WITH q AS (SELECT doc_id, text, regexp_extract(text, '^(?:\S+ ){3}(\S+ \S+ \S+)', 1) AS quote FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN quote <> '' THEN CAST(instr(text, quote) - 1 AS INTEGER) END AS start, CASE WHEN quote <> '' THEN CAST(instr(text, quote) - 1 + length(quote) AS INTEGER) END AS " + '"end", quote <> \'\' AS loose FROM q',
    "anchored_spans": "WITH a AS (SELECT doc_id, instr(text, 'the ') AS s, text FROM documents WHERE text IS NOT NULL), b AS (SELECT *, CASE WHEN s > 0 THEN instr(substring(text, s), '.') ELSE 0 END AS e FROM a) SELECT doc_id, CASE WHEN s > 0 AND e > 0 THEN CAST(s - 1 AS INTEGER) END AS start, CASE WHEN s > 0 AND e > 0 THEN CAST(s - 1 + e AS INTEGER) END AS \"end\", CASE WHEN s = 0 THEN 'start_not_found' WHEN e = 0 THEN 'end_not_found' ELSE 'found' END AS status FROM b",
    "link_nearness": ctes(s=SPANS) + "SELECT l.page, l.id AS link, min(greatest(0, q.start - l.stop, l.start - q.stop)) AS gap FROM (SELECT * FROM s WHERE event_type = 'error') l LEFT JOIN (SELECT * FROM s WHERE event_type = 'purchase') q ON l.page = q.page GROUP BY 1, 2",
    "activity_pairs": ctes(s=SPANS) + "SELECT a.page, a.id AS a, b.id AS b, CASE WHEN a.start = b.start THEN 'unresolved' ELSE 'ordered' END AS status FROM s a JOIN s b ON a.page = b.page AND a.event_type = 'error' AND b.event_type = 'error' AND (a.start < b.start OR a.start = b.start AND a.id < b.id)",
    "pool_positions": _POOL.format("nullif(source_date, '') IS NULL,"),
    "pool_positions_undated_first": _POOL.format("nullif(source_date, '') IS NOT NULL,"),
    "scrape_work_list": "WITH f AS (SELECT o_custkey AS institution, 'u' || (l_partkey % 90) AS url, min(l_orderkey * 10 + l_linenumber) AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY institution ORDER BY rank, url) <= 5) SELECT institution, string_agg(url, '|' ORDER BY rank, url) AS urls FROM n GROUP BY 1",
    "bypass_sites": ctes(o=OVERLAY) + ", r AS (SELECT *, CASE WHEN uid = '' THEN 'unusable' WHEN coalesce(lower(trim(confidence)), '') NOT IN ('high', 'medium') THEN 'below_confidence' WHEN site_root = '' THEN 'unusable' WHEN n_sharing > 1 THEN 'shared_host' END AS reason FROM o) SELECT uid, CASE WHEN reason IS NULL THEN site_root END AS site, reason FROM r",
    "likeliest_site": "SELECT o_custkey AS institution, arg_max('u' || o_orderkey, ((o_orderkey % 5) / 4.0, -o_orderkey)) AS url, max((o_orderkey % 5) / 4.0) AS probability FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY 1",
    "name_groups": "SELECT o_custkey AS scope, o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 4) AS \"group\" FROM orders",
    "kept_page_artifacts": "SELECT page_id FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 3 = 0)",
    "publishable_rows": "SELECT c_custkey AS uid, CASE WHEN c_nationkey % 5 <> 0 THEN 'b' || c_nationkey END AS block, c_nationkey % 5 <> 0 AND c_nationkey % 2 = 0 AND c_custkey % 4 <> 0 AS publishable FROM customer",
    "text_length_shares": "SELECT CAST(c AS INTEGER) AS cap, count(*) FILTER (length(text) > c) AS n_over, round(count(*) FILTER (length(text) > c) / count(*), 4) AS share_over FROM documents CROSS JOIN (VALUES (500), (2000), (8000)) v(c) GROUP BY 1",
    "label_cutoffs": _CUT,
    "tuned_cutoff": f"SELECT errors, cutoff, tp, fp, fn, tn FROM ({_CUT}) ORDER BY errors, cutoff LIMIT 1",
    "preflight_estimate": "WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT event_type AS stage, round(sum(event_id % 4) * 10000 / any_value(n), 4) AS credits, CAST(ceil(sum(event_id % 3) * 10000 / any_value(n)) AS BIGINT) AS jobs, round(sum(event_id % 4) * 10000 / any_value(n) * 0.001::DOUBLE + sum(event_id % 1000) * 10000 / any_value(n) * 0.000002::DOUBLE, 4) AS usd FROM events CROSS JOIN n GROUP BY 1",
    "resumed_spend": "SELECT api, round(sum(units), 4) AS units FROM (SELECT event_type AS api, CAST(event_id % 7 AS DOUBLE) AS units FROM events UNION ALL VALUES ('view', 10.5::DOUBLE), ('other', 3.0::DOUBLE)) GROUP BY 1",
    "robots_rules": "SELECT event_id AS id, CASE user_id % 6 WHEN 1 THEN event_id % 4 <> 1 WHEN 2 THEN false ELSE true END AS allowed FROM events",
    "run_liveness": "SELECT user_id AS run_id, 5000 - max(event_id * 13 % 5000) <= 300 AS live FROM events GROUP BY 1",
    "checked_codes": "WITH r AS (SELECT list_filter([CASE WHEN l_partkey % 3 = 0 THEN 'downgraded_quote' END, CASE WHEN l_suppkey % 4 < 2 THEN 'downgraded_entailment' END, CASE WHEN NOT l_discount * 10 >= 0.5 THEN 'downgraded_probability' END], lambda x: x IS NOT NULL) AS r FROM lineitem) SELECT coalesce(r[1], 'supported') AS status, r[2] AS second, count(*) AS n FROM r GROUP BY 1, 2",
    "extract_jobs": r"WITH t AS (SELECT doc_id % 30 AS institution, 'u' || doc_id AS url, text, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS bare FROM documents), c AS (SELECT *, length(text) AS n, format('{:,}', length(text) - 500) AS over FROM t WHERE bare >= 200) SELECT 'b1::' || institution || '::' || md5(url) AS custom_id, institution, CASE WHEN n <= 500 THEN n ELSE 500 + length(over) + 59 END AS n FROM c",
    "page_artifacts": "SELECT conv_id AS page, md5(string_agg(coalesce(text, ''), '' ORDER BY turn, coalesce(text, ''))) AS md5, string_agg(turn || ':' || length(coalesce(text, '')), ',' ORDER BY turn, coalesce(text, '')) AS segments FROM conversations GROUP BY 1",
    "kept_identity": "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'first ' || c_name ELSE c_name END AS launched, c_nationkey FROM customer",
    "gate_faults": ctes(i=ITEMS) + """, t AS (SELECT i.*, g.item IS NOT NULL AS known, i.pass < g.pass OR i.pass = g.pass AND i.round <= g.round AS early FROM i LEFT JOIN i g ON i.gate = g.item WHERE i.gate IS NOT NULL)
      SELECT item, CASE WHEN NOT known THEN 'unknown_gate' ELSE 'not_after_gate' END AS fault FROM t WHERE NOT known OR early UNION ALL SELECT a.item, 'circle' FROM i a JOIN i b ON a.gate = b.item AND b.gate = a.item""",
}
