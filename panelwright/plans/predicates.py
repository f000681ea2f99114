"""Queries on predicates: frame eligibility, archive and own addresses, topic signals, gates, rosters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import eligibility as E
from ..operators.consolidated import GENERATIVE, keyword_pattern
from .consolidated import _words
from .fixtures import ctes, rows

#: Website cells as a registry has them.
SITES = """SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 0 THEN NULL WHEN 1 THEN 'TBD' WHEN 2 THEN ' n/a ' WHEN 3 THEN 'https://www.Town' || c_custkey || '.gov/path?x=1' WHEN 4 THEN 'en.wikipedia.org/wiki/X'
      WHEN 5 THEN 'a.b' WHEN 6 THEN 'nodots' WHEN 7 THEN 'user@town' || c_custkey || '.org:8080/a' WHEN 8 THEN 'http://ban/a.example' WHEN 9 THEN 'none of them.org' WHEN 10 THEN '' ELSE 'city' || c_custkey || '.example/n/a1' END AS website,
    CASE c_custkey % 5 WHEN 0 THEN ' Yes ' WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN NULL ELSE 'T' END AS duplicate FROM {customer}"""


def name_collisions(spark, sf):
    return rows(spark, sf, SITES).select("id", E.has_colliding_name(F.col("duplicate")).alias("collides"))


def website_hosts(spark, sf):
    return rows(spark, sf, SITES).select("id", E.website_host(F.col("website")).alias("host"))


def placeholder_websites(spark, sf):
    return rows(spark, sf, SITES).where(E.is_placeholder(F.col("website"))).select("id")


def eligible_frame(spark, sf):
    return rows(spark, sf, SITES).where(E.is_eligible(F.col("website"))).select("id")


def blank_websites(spark, sf):
    return rows(spark, sf, SITES).where(E.website_blank(F.col("website"))).select("id")


URLS = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'https://web.archive.org/web/2020/x' WHEN 1 THEN 'http://www.archive.org/details/a' WHEN 2 THEN 'https://archive.org/about' WHEN 3 THEN 'https://Archive.PH./abc'
      WHEN 4 THEN 'no url' WHEN 5 THEN '//www.archive.today' WHEN 6 THEN NULL WHEN 7 THEN 'https://mail.town' || (user_id % 7) || '.gov/x' ELSE 'https://news.town' || (user_id % 7) || '.gov/ai' END AS url, 'town' || (user_id % 5) || '.gov' AS truth FROM {events}"""


def archive_addresses(spark, sf):
    return rows(spark, sf, URLS).select("event_id", E.archive_host(F.col("url")).alias("host"), E.is_archive_address(F.col("url")).alias("archived"))


def own_domain(spark, sf):
    return rows(spark, sf, URLS).where(E.is_own_domain(F.col("url"), F.col("truth"))).select("event_id")


RECORDS = """SELECT event_id, user_id, CASE event_id % 6 WHEN 0 THEN 'Use of AI in schools' WHEN 1 THEN 'J''ai vu Thai' WHEN 2 THEN NULL WHEN 3 THEN 'ChatGPT notes' WHEN 4 THEN 'GPT4o' ELSE 'Alberta budget' END AS title,
    CASE event_id % 4 WHEN 0 THEN 'plans' WHEN 1 THEN 'machine-learning unit' WHEN 2 THEN NULL ELSE '生成AI の利用' END AS snippet,
    'https://www.town' || (event_id % 4) || '.gov/' || (event_id % 30) AS link, 'town' || (user_id % 4) || '.gov' AS truth FROM {events}"""


def screen_signal(spark, sf):
    return rows(spark, sf, RECORDS).select("event_id", E.has_screen_signal(F.col("title"), F.col("snippet"), keyword_pattern(GENERATIVE), ("生成ai",)).alias("passes"))


def topic_signal(spark, sf):
    return rows(spark, sf, RECORDS).select("event_id", E.has_topic_signal(F.col("title"), F.col("snippet")).alias("signal"))


def discovery_scores(spark, sf):
    """Per institution: distinct URLs, those on its own domain, those of them with a signal; the first record of a URL counts."""
    r = rows(spark, sf, RECORDS)
    first = r.groupBy(F.col("user_id").alias("inst"), "link").agg(F.min(F.struct("event_id", "title", "snippet", "truth")).alias("r")).select("inst", "link", "r.*")
    own = E.is_own_domain(F.col("link"), F.col("truth"))
    relevant = own & E.has_topic_signal(F.col("title"), F.col("snippet"), F.col("link"))
    return first.groupBy("inst").agg(F.count(F.lit(1)).alias("n_urls"), F.count_if(own).alias("n_own"), F.count_if(relevant).alias("n_relevant"), F.bool_or(relevant).alias("hit"))


def discovery_run_totals(spark, sf):
    s = discovery_scores(spark, sf)
    return s.agg(F.count(F.lit(1)).alias("n_institutions"), F.sum("n_urls").alias("n_urls"), F.sum("n_own").alias("n_own"), F.count_if("hit").alias("n_hits"), F.round(F.count_if("hit") / F.count(F.lit(1)), 4).alias("hit_rate"))


def first_own_rank(spark, sf):
    """Per institution the first rank at which its own domain was found."""
    r = rows(spark, sf, RECORDS)
    return r.groupBy(F.col("user_id").alias("inst")).agg(F.min(F.when(E.is_own_domain(F.col("link"), F.col("truth")), F.col("event_id"))).alias("rank"))


def unreviewed_sources(spark, sf):
    return rows(spark, sf, "SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'fetch_failed' WHEN 2 THEN NULL WHEN 3 THEN 'link_not_followed_cap' ELSE 'other' END AS state FROM {lineitem}").where(E.is_unreviewed(F.col("state"))).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def refusal_statuses(spark, sf):
    return rows(spark, sf, "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 451 WHEN 4 THEN NULL WHEN 5 THEN 401 ELSE 500 END AS status FROM {events}").select("event_id", E.is_refusal(F.col("status")).alias("refused"))


def gated_questions(spark, sf):
    a = rows(spark, sf, "SELECT o_orderkey, o_orderstatus AS answer, o_orderkey % 6 = 0 AS stopped FROM {orders}")
    return a.select("o_orderkey", E.gate(F.col("answer"), ("F", "P"), F.col("stopped")).alias("open"))


def triage_keeps(spark, sf):
    a = rows(spark, sf, "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE (event_id % 7) / 6.0 END AS p FROM {events}")
    return a.where(E.keeps(F.col("p"))).select("event_id")


def unrostered_languages(spark, sf):
    return E.unrostered(rows(spark, sf, "SELECT lang AS language FROM {documents}"), spark.createDataFrame([("en",), ("fr",)], "language string"))


CHECKS = "SELECT l_orderkey AS observation, CASE l_suppkey % 9 WHEN 0 THEN 'failed' ELSE 'supported' END AS status FROM {lineitem} WHERE l_linenumber < 5"


def supported_observations(spark, sf):
    return E.supported_observations(rows(spark, sf, "SELECT o_orderkey AS observation FROM {orders}"), rows(spark, sf, CHECKS))


def open_failures(spark, sf):
    failures = rows(spark, sf, "SELECT event_id, user_id AS inst, event_id % 3 AS stage FROM {events} WHERE event_type = 'error'")
    return E.open_failures(failures, rows(spark, sf, "SELECT user_id AS inst, event_id % 3 AS stage FROM {events} WHERE event_type = 'purchase'"), ["inst", "stage"])


#: Public-suffix rules for the query; a user passes the public list.
RULES = ("com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "gov")
HOSTS = """SELECT DISTINCT CASE event_id % 8 WHEN 0 THEN 'a.b.example.com' WHEN 1 THEN 'x.co.uk' WHEN 2 THEN 'co.uk' WHEN 3 THEN 'www.ck' WHEN 4 THEN 'a.b.c.ck' WHEN 5 THEN 'q.city.kawasaki.jp' WHEN 6 THEN 'z.y.kawasaki.jp'
    ELSE 'n' || (user_id % 90) || '.u' || (user_id % 4) || '.zz' END AS host FROM {events}"""


def suffix_rule_domains(spark, sf):
    return E.registrable_domains(rows(spark, sf, HOSTS), spark.createDataFrame([(r,) for r in RULES], "rule string"))


QUERIES = {
    f.__name__: f
    for f in (
        name_collisions, website_hosts, placeholder_websites, eligible_frame, blank_websites, archive_addresses, own_domain, screen_signal, topic_signal, discovery_scores,
        discovery_run_totals, first_own_rank, unreviewed_sources, refusal_statuses, gated_questions, triage_keeps, unrostered_languages, supported_observations, open_failures, suffix_rule_domains,
    )
}

_HOST = r"CASE WHEN contains(website, '//') THEN regexp_extract(website, '^[^/]*//([^/?#]*)', 1) ELSE regexp_extract(website, '^([^/?#]*)', 1) END"
SITE = ctes(s=SITES) + rf""", h AS (SELECT *, lower(regexp_replace(regexp_replace({_HOST}, '^.*@', ''), ':[0-9]*$', '')) AS h FROM s),
    t AS (SELECT *, trim(coalesce(website, '')) AS bare, CASE WHEN contains(h, '.') THEN h END AS host, coalesce(regexp_matches(' ' || lower(website) || ' ', '[^a-z0-9]n/a[^a-z0-9]') OR regexp_matches(lower(website), 'data\.ipu\.org|wikipedia\.org|wikimedia\.org|tbd|none'), false) AS junk FROM h)"""
_ARCHIVE = r"nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '\.$', ''), '^www\.(.)', '\1'), '')"
_PHRASE = "|".join(E.PHRASES)
_TOPIC = "coalesce(regexp_matches(' ' || {0} || ' ', '[^A-Za-z](AI|LLM)[^A-Za-z]') OR regexp_matches(regexp_replace(lower({0}), '[-_/+.,:;]+', ' ', 'g'), '" + _PHRASE + "'), false)"
_OWN = r"regexp_extract(link, '^https://www\.([^/]*)', 1) = truth"
SCORES = ctes(r=RECORDS) + f""", f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, link ORDER BY event_id) = 1), g AS (SELECT user_id AS inst, {_OWN} AS own, {_OWN} AND ({_TOPIC.format('title')} OR {_TOPIC.format('snippet')} OR {_TOPIC.format('link')}) AS rel FROM f),
    s AS (SELECT inst, count(*) AS n_urls, count(*) FILTER (own) AS n_own, count(*) FILTER (rel) AS n_relevant, bool_or(rel) AS hit FROM g GROUP BY 1)"""
ORACLES = {
    "name_collisions": ctes(s=SITES) + "SELECT id, coalesce(lower(trim(duplicate)) IN ('1', 'true', 't', 'yes', 'y'), false) AS collides FROM s",
    "website_hosts": SITE + " SELECT id, host FROM t",
    "placeholder_websites": SITE + " SELECT id FROM t WHERE junk",
    "eligible_frame": SITE + " SELECT id FROM t WHERE length(bare) >= 5 AND host IS NOT NULL AND NOT junk",
    "blank_websites": SITE + " SELECT id FROM t WHERE bare IN ('', 'TBD')",
    "archive_addresses": ctes(u=URLS) + f", h AS (SELECT event_id, url, {_ARCHIVE} AS host FROM u) SELECT event_id, host, coalesce(host IN {E.ARCHIVES} OR host = 'archive.org' AND contains(url, 'archive.org/details/'), false) AS archived FROM h",
    "own_domain": ctes(u=URLS) + r"SELECT event_id FROM u WHERE regexp_extract(url, '^https://news\.([^/]*)', 1) = truth",
    "screen_signal": ctes(r=RECORDS) + f", t AS (SELECT event_id, lower(trim(coalesce(title, '') || ' ' || coalesce(snippet, ''))) AS snippet FROM r) SELECT event_id, snippet = '' OR {_words(GENERATIVE)} OR regexp_matches(' ' || snippet, '[^\\w]gpt-?[0-9]') OR contains(snippet, '生成ai') AS passes FROM t",
    "topic_signal": ctes(r=RECORDS) + f"SELECT event_id, {_TOPIC.format('title')} OR {_TOPIC.format('snippet')} AS signal FROM r",
    "discovery_scores": SCORES + " SELECT * FROM s",
    "discovery_run_totals": SCORES + " SELECT count(*) AS n_institutions, CAST(sum(n_urls) AS BIGINT) AS n_urls, CAST(sum(n_own) AS BIGINT) AS n_own, count(*) FILTER (hit) AS n_hits, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate FROM s",
    "first_own_rank": ctes(r=RECORDS) + f"SELECT user_id AS inst, min(event_id) FILTER ({_OWN}) AS rank FROM r GROUP BY 1",
    "unreviewed_sources": "SELECT CASE l_partkey % 5 WHEN 1 THEN 'fetch_failed' ELSE 'link_not_followed_cap' END AS state, count(*) AS n FROM lineitem WHERE l_partkey % 5 IN (1, 3) GROUP BY 1",
    "refusal_statuses": "SELECT event_id, event_id % 7 IN (1, 3, 5) AS refused FROM events",
    "gated_questions": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus IN ('F', 'P') END AS open FROM orders",
    "triage_keeps": "SELECT event_id FROM events WHERE event_id % 10 <> 0 AND event_id % 7 >= 3",
    "unrostered_languages": "SELECT DISTINCT lang AS language FROM documents WHERE lang NOT IN ('en', 'fr')",
    "supported_observations": ctes(c=CHECKS) + "SELECT o_orderkey AS observation, coalesce(bool_and(status = 'supported'), false) AS supported FROM orders LEFT JOIN c ON observation = o_orderkey GROUP BY 1",
    "open_failures": "SELECT event_id, user_id AS inst, event_id % 3 AS stage FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.event_id % 3 = e.event_id % 3)",
    "suffix_rule_domains": ctes(h=HOSTS) + r"SELECT host, CASE WHEN host = 'a.b.example.com' THEN 'example.com' WHEN host = 'x.co.uk' THEN host WHEN host = 'co.uk' THEN NULL WHEN host = 'www.ck' THEN 'www.ck' WHEN host = 'a.b.c.ck' THEN 'b.c.ck' WHEN host = 'q.city.kawasaki.jp' THEN 'city.kawasaki.jp' WHEN host = 'z.y.kawasaki.jp' THEN 'z.y.kawasaki.jp' ELSE regexp_replace(host, '^[^.]*\.', '') END AS domain FROM h",
}
