"""Queries on row shaping, source fields, quotes and link following."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quotes
from ..operators import evidence, rows
from ..session import table


def institution_records(spark, sf):
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string")).alias("master_row_id"), F.col("c_name").alias("institution_name"), F.col("c_mktsegment").alias("institution_type"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("w"), F.col("c_custkey").cast("string"))).alias("website"))
    return rows.institution_record(c).select("institution_id", "institution_name", "country", "institution_type", "website", "official_site_url", "master_row_id")


def activity_rows(spark, sf):
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("activities"))
    return rows.child_rows(items, "activities", "l_orderkey", "A", "run7").select("l_orderkey", "local_id", "global_row_id", "l_partkey", "l_returnflag")


def sweep_uids(spark, sf):
    uid = F.when(F.col("s_suppkey") % 9 == 0, "bad").otherwise(F.concat(F.lit("P-I-"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")))
    return table(spark, sf, "supplier").select("s_suppkey", rows.tail_uid(uid, "^P-I-[0-9]{8}$", "P-S-").alias("sweep_uid"))


def legacy_rows(spark, sf):
    return rows.legacy_row(table(spark, sf, "region").select("r_regionkey", "r_name"), {"wave": "not_asked", "channel": "before_release"})


def public_projection(spark, sf):
    from ..functions.text import emails

    d = table(spark, sf, "documents").select("doc_id", "source", emails(F.col("text")).alias("emails"))
    out = rows.public_projection(d, ["source"], "emails")
    return out.select("doc_id", F.array_join(F.transform("emails_by_domain", lambda x: F.concat(x["domain"], F.lit("="), x["n"].cast("string"))), ",").alias("domains"))


def display_rollup(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("rank"), F.get(F.array(F.lit("no"), F.lit("unknown"), F.lit("no"), F.lit("pilot"), F.lit("live")), (F.col("l_partkey") % 5).cast("int")).alias("value"), F.col("l_suppkey").alias("src"))
    out = rows.first_positive(li, "unit", "rank", "value", "src")
    return out.select("unit", "value", F.array_join(F.transform("holders", lambda h: h.cast("string")), "|").alias("holders"))


def _source_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    pick = lambda options, n: F.get(F.array(*[F.lit(o) for o in options]), (F.col("l_partkey") % n).cast("int"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("src"), F.col("l_orderkey").alias("activity"), pick(["own_official", "other_official", "no", "unknown"], 4).alias("official"), (F.col("l_suppkey") % 3 == 0).alias("archived"), pick(["news", "vendor", "law", "blog", "forum"], 5).alias("type"), pick(["2020", "unknown", "not_documented", "2021-05", "2019-01-02", "2018"], 6).alias("published"), (F.col("l_linenumber") > 2).alias("followed"), F.when(F.col("l_linenumber") != 5, F.col("l_linenumber") - 2).alias("hop"), (F.col("l_linenumber") == 7).alias("backfill"))


SRC = """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS src, l_orderkey AS activity, ['own_official', 'other_official', 'no', 'unknown'][CAST(l_partkey % 4 AS INT) + 1] AS official, l_suppkey % 3 = 0 AS archived,
  ['news', 'vendor', 'law', 'blog', 'forum'][CAST(l_partkey % 5 AS INT) + 1] AS type, ['2020', 'unknown', 'not_documented', '2021-05', '2019-01-02', '2018'][CAST(l_partkey % 6 AS INT) + 1] AS published,
  l_linenumber > 2 AS followed, CASE WHEN l_linenumber <> 5 THEN l_linenumber - 2 END AS hop, l_linenumber = 7 AS backfill FROM lineitem) """
CELLS = {"news": "medium", "vendor": "low", "law": "high", "blog": "low"}


def source_fields(spark, sf):
    s = _source_rows(spark, sf)
    shaped = s.select(evidence.route_source_type(F.col("official"), F.col("archived")).alias("routed"), evidence.discovery_path(F.col("followed"), F.col("hop"), F.col("backfill")).alias("path"), evidence.source_credibility(F.col("type"), F.col("published"), CELLS).alias("credibility"))
    return shaped.groupBy("routed", "path", "credibility").agg(F.count(F.lit(1)).alias("n"))


def source_confidence(spark, sf):
    s = _source_rows(spark, sf)
    checks = s.select(F.col("activity").alias("src"), F.when(F.col("type") == "forum", "downgraded_no_quote").when(F.col("published") == "2018", None).otherwise("supported").alias("status"), F.when((F.col("type") == "blog") & F.col("archived"), "downgraded_low_confidence").alias("second_reason"))
    cred = table(spark, sf, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("src"), F.lit("medium").alias("credibility"))
    return evidence.source_confidence(checks, cred, "src")


def vendor_claim_only(spark, sf):
    t = _source_rows(spark, sf).select("activity", F.when(F.col("src") % 23 != 0, F.when(F.col("activity") % 3 == 0, "vendor").otherwise(F.col("type"))).alias("type"))
    return evidence.vendor_claim_only(t, "activity")


def deterministic_dates(spark, sf):
    s = _source_rows(spark, sf).where("published LIKE '2%'").select(F.col("activity").alias("page"), (F.col("src") % 3).alias("tag_rank"), F.col("published").alias("value"))
    return evidence.deterministic_date(s, "page")


def latest_observation(spark, sf):
    s = _source_rows(spark, sf).where("published LIKE '2%'").select("activity", F.col("published").alias("value"))
    return evidence.latest_observation(s, "activity")


def follow_links(spark, sf):
    starts = table(spark, sf, "nation").select(F.col("n_nationkey").alias("institution"), (F.col("n_nationkey") * 31 % 200).alias("url"))
    links = table(spark, sf, "part").select((F.col("p_partkey") % 200).alias("url"), (F.col("p_partkey") * 7 % 211).alias("to"), (F.col("p_partkey") * 13 % 97).alias("nearness"))
    return evidence.follow(starts, links, 3, 5)


def provenance_origins(spark, sf):
    p = table(spark, sf, "part")
    d = p.select(F.col("p_partkey").alias("record"), F.when(F.col("p_partkey") % 50 == 0, F.col("p_partkey") + 1).otherwise(F.floor(F.col("p_partkey") / 3)).alias("source"))
    return evidence.origins(d)


def quote_match(spark, sf):
    """Each document against a passage of itself; a text that ends before the passage, or null, has no quote: score 0, the rest null."""
    quote = F.when(F.length("text") >= 50, F.concat(F.substring("text", 50, 60), F.when(F.col("doc_id") % 2 == 0, " zzz qqq www vvv uuu ttt sss rrr").otherwise("")))
    return table(spark, sf, "documents").select("doc_id", quotes.match_quote(quote, F.col("text")).alias("m")).select("doc_id", "m.*")


def display_cap(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.left(F.col("text"), F.lit(200))).alias("shown"), (F.length("text") > 200).alias("capped"))


QUERIES = {f.__name__: f for f in (institution_records, activity_rows, sweep_uids, legacy_rows, public_projection, display_rollup, source_fields, source_confidence, vendor_claim_only, deterministic_dates, latest_observation, follow_links, provenance_origins, quote_match, display_cap)}

_FIRST = "CAST(value || CASE length(value) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END AS DATE)"
_LAST = f"CASE length(value) WHEN 4 THEN CAST(value || '-12-31' AS DATE) WHEN 7 THEN last_day({_FIRST}) ELSE {_FIRST} END"
ORACLES = {
    "institution_records": "SELECT CASE WHEN c_custkey % 10 = 0 THEN 'INST-x' || c_custkey ELSE 'INST-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS institution_id, c_name AS institution_name, '' AS country, c_mktsegment AS institution_type, CASE WHEN c_custkey % 3 <> 0 THEN 'w' || c_custkey END AS website, CAST(NULL AS VARCHAR) AS official_site_url, CASE WHEN c_custkey % 10 = 0 THEN 'x' ELSE '' END || c_custkey AS master_row_id FROM customer",
    "activity_rows": "WITH a AS (SELECT *, 'A' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS local_id FROM lineitem) SELECT l_orderkey, local_id, 'run7::' || l_orderkey || '::' || local_id AS global_row_id, l_partkey, l_returnflag FROM a",
    "sweep_uids": "SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN 'P-S-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS sweep_uid FROM supplier",
    "legacy_rows": "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS wave, CAST(NULL AS VARCHAR) AS channel, '{\"channel\":\"before_release\",\"wave\":\"not_asked\"}' AS unavailable FROM region",
    "public_projection": "WITH e AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'), lambda x: lower(x)))) AS e FROM documents), d AS (SELECT doc_id, split_part(e, '@', -1) AS domain, count(*) AS n FROM e GROUP BY 1, 2), j AS (SELECT doc_id, string_agg(domain || '=' || n, ',' ORDER BY domain) AS domains FROM d GROUP BY 1) SELECT doc_id, coalesce(domains, '') AS domains FROM documents LEFT JOIN j USING (doc_id)",
    "display_rollup": "WITH l AS (SELECT l_orderkey AS unit, l_linenumber AS rank, ['no', 'unknown', 'no', 'pilot', 'live'][CAST(l_partkey % 5 AS INT) + 1] AS value, l_suppkey AS src FROM lineitem), b AS (SELECT unit, coalesce((list(value ORDER BY rank, value) FILTER (value IN ('pilot', 'live')))[1], 'no') AS value FROM l GROUP BY 1), h AS (SELECT unit, value, array_to_string(list_sort(list(DISTINCT src)), '|') AS holders FROM l GROUP BY 1, 2) SELECT unit, value, coalesce(holders, '') AS holders FROM b LEFT JOIN h USING (unit, value)",
    "source_fields": SRC + "SELECT CASE WHEN official IN ('own_official', 'other_official') THEN 'official_domain' WHEN archived THEN 'archive_address' END AS routed, CASE WHEN NOT followed AND NOT backfill THEN 'searched' WHEN followed AND backfill THEN 'backfill_followed' WHEN followed AND hop >= 1 THEN 'followed_hop_' || hop END AS path, CASE WHEN published IN ('unknown', 'not_documented') THEN 'low' ELSE CASE type WHEN 'news' THEN 'medium' WHEN 'law' THEN 'high' WHEN 'vendor' THEN 'low' WHEN 'blog' THEN 'low' END END AS credibility, count(*) AS n FROM s GROUP BY 1, 2, 3",
    "source_confidence": SRC + ", c AS (SELECT activity AS src, bool_or(type = 'forum' OR type = 'blog' AND archived) AS failed, bool_or(type <> 'forum' AND published = '2018') AS pending FROM s GROUP BY 1) SELECT src, CASE WHEN failed THEN 'low' WHEN pending THEN 'unfinished' WHEN src % 4 <> 0 AND src IN (SELECT o_orderkey FROM orders) THEN 'medium' ELSE 'unknown' END AS confidence FROM c",
    "vendor_claim_only": SRC + ", t AS (SELECT activity, CASE WHEN src % 23 <> 0 THEN CASE WHEN activity % 3 = 0 THEN 'vendor' ELSE type END END AS type FROM s) SELECT activity, CASE WHEN bool_or(type IS NULL) THEN 'unknown' WHEN bool_and(type = 'vendor') THEN 'yes' ELSE 'no' END AS value FROM t GROUP BY 1",
    "deterministic_dates": SRC + ", t AS (SELECT activity AS page, src % 3 AS r, published AS value, min(src % 3) OVER (PARTITION BY activity) AS best FROM s WHERE published LIKE '2%'), b AS (SELECT page, (list(value ORDER BY length(value) DESC, value DESC))[1] AS v, list(DISTINCT value) AS l FROM t WHERE r = best GROUP BY 1) SELECT page, v AS value, len(list_filter(l, lambda x: NOT starts_with(v, x))) = 0 AS consistent FROM b",
    "latest_observation": SRC + f", r AS (SELECT DISTINCT activity, published AS value, {_FIRST.replace('value', 'published')} AS f, {_LAST.replace('value', 'published')} AS l FROM s WHERE published LIKE '2%'), t AS (SELECT activity, (list(value ORDER BY f DESC, length(value)))[1] AS v, max(f) AS tf FROM r GROUP BY 1) SELECT activity, any_value(v) AS value, bool_or(value <> v AND l >= tf) AS ambiguous FROM r JOIN t USING (activity) GROUP BY 1",
    "display_cap": "SELECT doc_id, md5(left(text, 200)) AS shown, length(text) > 200 AS capped FROM documents",
}
