"""URL, text and date queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators import packing, resolve, similarity
from ..session import table



def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url")


def url_site_host(spark, sf):
    return _pages(spark, sf).select("page_id", urls.site_host(F.col("url")).alias("host"))


def url_root(spark, sf):
    return _pages(spark, sf).select("page_id", urls.site_root(F.col("url")).alias("root"))


def url_dedupe_key(spark, sf):
    return _pages(spark, sf).select("page_id", urls.dedupe_key(F.col("url")).alias("key"))


def url_md5_shard(spark, sf):
    return _pages(spark, sf).groupBy(urls.shard_of(F.col("url")).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min(urls.url_hash(F.col("url"))).alias("least"))


def url_exact_host_path(spark, sf):
    return _pages(spark, sf).select("page_id", urls.exact_host(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))


def _mixed_urls(spark, sf):
    """Page URLs, every seventh replaced by one that a screening rule is about."""
    kinds = ["/robots.txt", "/sitemap_index.xml", "/news/feed/", "/login.aspx", "/search?query=ai", "/a?search=x", "/register/ai"]
    hosts = ["bit.ly/x1", "twitter.com/dept", "x.com/a/status/1", "www.linkedin.com/company/abc", "linkedin.com/pulse/abc", "facebook.com/", "webmail.example.org/in"]
    pick = lambda options: F.get(F.array(*map(F.lit, options)), (F.col("page_id") % 7).cast("int"))
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://"), pick(hosts))).when(F.col("page_id") % 3 == 1, F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), pick(kinds))).otherwise(F.col("url"))
    return _pages(spark, sf).withColumn("url", u)


MIXED = """WITH p AS (SELECT page_id, CASE page_id % 3
  WHEN 0 THEN 'https://' || ['bit.ly/x1', 'twitter.com/dept', 'x.com/a/status/1', 'www.linkedin.com/company/abc', 'linkedin.com/pulse/abc', 'facebook.com/', 'webmail.example.org/in'][CAST(page_id % 7 AS INT) + 1]
  WHEN 1 THEN regexp_extract(url, '^(https?://[^/]+)', 1) || ['/robots.txt', '/sitemap_index.xml', '/news/feed/', '/login.aspx', '/search?query=ai', '/a?search=x', '/register/ai'][CAST(page_id % 7 AS INT) + 1]
  ELSE url END AS url FROM pages),
 q AS (SELECT page_id, url, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), ':.*$', ''), '^www\\.', '') AS host, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS path, lower(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)) AS asked FROM p) """


def url_screen_rules(spark, sf):
    s = urls.screen(F.col("url"))
    return _mixed_urls(spark, sf).select("page_id", s["decision"].alias("decision"), F.array_join(s["matched_rules"], ",").alias("rules"), s["reason"].alias("reason"))


def usable_domains(spark, sf):
    host = urls.host_of(F.col("url"))
    return _mixed_urls(spark, sf).groupBy(host.alias("host")).agg(F.bool_or(urls.is_usable_domain(host)).alias("usable"), F.count(F.lit(1)).alias("n"))


def _hosts(spark, sf):
    return _pages(spark, sf).withColumn("host", urls.site_host(F.col("url")))


def host_share_counts(spark, sf):
    return resolve.shared_counts(_hosts(spark, sf), "host").select("page_id", "host", "n_sharing")


def top_shared_hosts(spark, sf):
    return resolve.top_shared(_hosts(spark, sf), "host", 20)


def first_usable_domain(spark, sf):
    p = _mixed_urls(spark, sf).select((F.col("page_id") % 20).alias("institution"), "page_id", urls.host_of(F.col("url")).alias("host"))
    return resolve.first_usable(p, "institution", "page_id", "host", urls.is_usable_domain(F.col("host")))


def dedupe_union(spark, sf):
    p = _pages(spark, sf)
    legs = p.select("page_id", F.col("url"), F.lit(1).alias("leg")).union(p.where("page_id % 2 = 0").select((F.col("page_id") + 100000).alias("page_id"), F.concat(F.col("url"), F.lit("/")).alias("url"), F.lit(2).alias("leg")))
    rows = legs.select((F.col("page_id") % 5).alias("institution"), "page_id", "leg", urls.dedupe_key(F.col("url")).alias("key"))
    return resolve.dedupe_ordered(rows, "institution", "key", "leg", "page_id").select("institution", "key", "page_id", "leg")


def site_queries(spark, sf):
    terms = F.explode(F.array(F.lit("artificial intelligence"), F.lit("chatbot"))).alias("term")
    return table(spark, sf, "supplier").select("s_suppkey", "s_name", terms).select("s_suppkey", "term", urls.site_query(F.col("term"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".gov"))).alias("site_query"), F.concat_ws(" ", urls.phrase(F.col("s_name")), urls.hint(F.concat(F.lit("(-"), "term", F.lit(")")))).alias("open_query"))


def found_by_union(spark, sf):
    """Results of several queries by exact URL: the first position, and every distinct query that found it."""
    p = _pages(spark, sf).select(F.concat(F.lit("u"), (F.col("page_id") % 60).cast("string")).alias("link"), F.concat(F.lit("q"), (F.col("page_id") % 7).cast("string")).alias("query"), "page_id")
    return p.groupBy("link").agg(F.min("page_id").alias("first"), F.array_join(F.array_sort(F.collect_set("query")), "|").alias("found_by"))


def url_dates(spark, sf):
    u = F.concat(F.regexp_extract(F.col("url"), "^(https?://[^/]+)", 1), F.lit("/news/20"), F.lpad((F.col("page_id") % 30).cast("string"), 2, "0"), F.lit("/"), F.lpad((F.col("page_id") % 15).cast("string"), 2, "0"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/"), F.lpad((F.col("page_id") % 33).cast("string"), 2, "0"))).otherwise(F.lit("")), F.lit("/x"))
    return _pages(spark, sf).select("page_id", F.array_join(dates.url_dates(urls.path(u)), ",").alias("dates"))


def iso_partial_period(spark, sf):
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm'Z'"))
    p = dates.normalise_iso(raw)
    return o.select("o_orderkey", p.alias("partial"), dates.first_day(p).cast("string").alias("first_day"), dates.last_day(p).cast("string").alias("last_day"), dates.in_window(p, F.lit("1997-06-15").cast("date")).alias("in_window"))


def year_candidates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), F.concat(F.lit("in "), (2010 + F.col("doc_id") % 25).cast("string"), F.lit(" and 12345, 2020.")), "lang").alias("t"))
    return d.select("doc_id", F.explode(dates.years_in(F.col("t"))).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def run_id_times(spark, sf):
    stamp = F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'")
    return table(spark, sf, "orders").select("o_orderkey", dates.run_started_at(F.concat(F.lit("run-"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("none")).otherwise(stamp), F.lit("-a1"))).cast("string").alias("started"))




def _docs(spark, sf):
    return table(spark, sf, "documents")


def readability_letter_share(spark, sf):
    shared = _docs(spark, sf).select("doc_id", "text", text.letter_share(F.col("text")).alias("exact"))
    return shared.select("doc_id", F.round("exact", 4).alias("share"), text.readability_failure(F.col("text"), F.col("exact")).alias("failure"))


def near_empty(spark, sf):
    return _docs(spark, sf).groupBy("lang").agg(F.count_if(text.is_near_empty(F.col("text"), 200)).alias("n_near_empty"), F.count(F.lit(1)).alias("n"))


def cap_text(spark, sf):
    c = text.capped(F.col("text"), 1000)
    return _docs(spark, sf).select("doc_id", F.md5(F.concat(F.substring(c, 1, 500), F.lit("|"), F.substring(c, -500, 500))).alias("ends"), (F.length(F.col("text")) > 1000).alias("truncated"), F.length(c).cast("long").alias("n"))


def keyword_proximity(spark, sf):
    return _docs(spark, sf).select("doc_id", text.keywords_near(F.coalesce(F.col("text"), F.lit("")), ("ttion", "wher"), 30).alias("near"))


def email_domain_counts(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.explode(text.email_domains(text.emails(F.col("text")))).alias("d"))
    return d.groupBy("d.domain").agg(F.sum("d.n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


def word_presence(spark, sf):
    """For each benchmark passage the highest share of its words that one of the documents of each language holds (quote check)."""
    b = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("w"))
    n = b.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    d = _docs(spark, sf).select("doc_id", "lang", F.explode(F.array_distinct(text.words(F.coalesce(F.col("text"), F.lit(""))))).alias("w"))
    shares = d.join(b, "w").groupBy("item_id", "lang", "doc_id").agg(F.count(F.lit(1)).alias("k")).join(n, "item_id")
    return shares.groupBy("item_id", "lang").agg(F.round(F.max(F.col("k") / F.col("n")), 4).alias("presence"))


def quote_window(spark, sf):
    q = F.substring(F.col("text"), 301, 40)
    return _docs(spark, sf).where(F.length(F.col("text")) > 400).select("doc_id", F.md5(text.window_around(q, F.col("text"), 50)).alias("window"))


def token_estimate(spark, sf):
    return _docs(spark, sf).groupBy("lang").agg(F.sum(packing.token_estimate(F.coalesce(F.col("text"), F.lit("")), {"latin": 0.25, "cjk": 0.5, "thai": 0.5})).cast("long").alias("tokens"))


def chunk_pages(spark, sf):
    return packing.chunk_pages(_docs(spark, sf).where("text IS NOT NULL"), "doc_id", "text", 1500).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.max("end").cast("long").alias("chars"))


def chunks_are_lossless(spark, sf):
    c = packing.chunk_pages(_docs(spark, sf).where("text IS NOT NULL"), "doc_id", "text", 1500)
    return c.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda s: s["text"]), "")).alias("again"))


def greedy_pack(spark, sf):
    items = _docs(spark, sf).select("source", "doc_id", "n_chars")
    return packing.greedy_chunks(items, "source", "doc_id", "n_chars", 20_000, 8)


def _near_docs(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").alias("key"), "text")


def shingle_jaccard_pairs(spark, sf):
    return similarity.similar_pairs(_near_docs(spark, sf)).select("a", "b", "shared", "united")


def near_duplicate_groups(spark, sf):
    return similarity.near_duplicate_groups(_near_docs(spark, sf))


def independence_groups(spark, sf):
    rows = _docs(spark, sf).select(F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("c"), (F.col("n_chars") % 997).cast("string"))).alias("copy_group"), F.concat(F.lit("k"), (F.col("doc_id") % 613).cast("string")).alias("url_key"))
    return similarity.independence_groups(rows)


QUERIES = {f.__name__: f for f in (url_site_host, url_root, url_dedupe_key, url_md5_shard, url_exact_host_path, url_screen_rules, usable_domains, host_share_counts, top_shared_hosts, first_usable_domain, dedupe_union, site_queries, found_by_union, url_dates, iso_partial_period, year_candidates, run_id_times, readability_letter_share, near_empty, cap_text, keyword_proximity, email_domain_counts, word_presence, quote_window, token_estimate, chunk_pages, chunks_are_lossless, greedy_pack, shingle_jaccard_pairs, near_duplicate_groups, independence_groups)}

HOST = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^.*@', ''), '^www\\.', '')"
PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
KEY = f"lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {HOST} || regexp_replace({PATH}, '/$', '') || CASE WHEN regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) ELSE '' END"
USABLE = "host LIKE '%.%' AND NOT regexp_matches(host, '(^|\\.)(twitter\\.com|x\\.com|linkedin\\.com|facebook\\.com)$') AND NOT regexp_matches(host, '^(webmail|mail)\\.')"
WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')"
SHINGLES = f"""WITH RECURSIVE w AS (SELECT doc_id AS key, {WORDS} AS w FROM documents), firsts AS (SELECT w, min(key) AS key FROM w GROUP BY 1),
  s AS (SELECT key, list_distinct(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s FROM firsts WHERE len(w) >= 5),
  x AS (SELECT key, len(s) AS n, unnest(s) AS h FROM s),
  pairs AS (SELECT a.key AS a, b.key AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS united FROM x a JOIN x b ON a.h = b.h AND a.key < b.key GROUP BY 1, 2 HAVING 5 * count(*) >= 4 * (any_value(a.n) + any_value(b.n) - count(*))) """
ORACLES = {
    "url_site_host": f"SELECT page_id, nullif({HOST}, '') AS host FROM pages",
    "url_root": f"SELECT page_id, 'https://' || nullif({HOST}, '') || '/' AS root FROM pages",
    "url_dedupe_key": f"SELECT page_id, {KEY} AS key FROM pages",
    "url_md5_shard": "SELECT left(md5(url), 2) AS shard, count(*) AS n, min(md5(url)) AS least FROM pages GROUP BY 1",
    "url_exact_host_path": f"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^.*@', '') AS host, regexp_replace({PATH}, '/+$', '') AS path FROM pages",
    "url_screen_rules": MIXED + """, h AS (SELECT page_id, list_sort(list_filter([
        CASE WHEN regexp_matches(path, '(^|/)robots\\.txt$') THEN 'robots_txt' END,
        CASE WHEN regexp_matches(path, '(^|/)sitemap[a-z0-9._-]*\\.(xml|php|aspx|html?|jsp)$') THEN 'sitemap' END,
        CASE WHEN regexp_matches(path, '\\.(ics|rss|atom)$|(^|/)(feed|rss|atom)/?$') THEN 'calendar_feed' END,
        CASE WHEN regexp_matches(path, '(^|/)(login|log-in|signin|sign-in|signup|sign-up|logout|log-out|oauth|sso)(/|$|\\.(php|aspx|html?|jsp)(/|$))') THEN 'login_auth' END,
        CASE WHEN regexp_matches(path, '(^|/)(search|search-results)(/|$|\\.(php|aspx|html?|jsp)(/|$))') OR regexp_matches(asked, '(^|&)(query|search)=') THEN 'search_results' END,
        CASE WHEN host = 'bit.ly' THEN 'url_shortener' END,
        CASE WHEN host IN ('twitter.com', 'x.com', 'facebook.com') AND len(list_filter(string_split(path, '/'), lambda s: s <> '')) <= 1 OR host = 'linkedin.com' AND path LIKE '/company/%' THEN 'social_media_profile' END],
        lambda r: r IS NOT NULL)) AS rules FROM q)
      SELECT page_id, CASE WHEN len(rules) > 0 THEN 'drop' ELSE 'pass' END AS decision, array_to_string(rules, ',') AS rules, CASE WHEN len(rules) > 0 THEN 'url_pattern_noncontent' END AS reason FROM h""",
    "usable_domains": MIXED + f"SELECT host, bool_or({USABLE}) AS usable, count(*) AS n FROM q GROUP BY 1",
    "host_share_counts": f"SELECT page_id, {HOST} AS host, count(*) OVER (PARTITION BY {HOST}) AS n_sharing FROM pages",
    "top_shared_hosts": f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, host LIMIT 20",
    "first_usable_domain": MIXED + f"SELECT page_id % 20 AS institution, min_by(host, page_id) FILTER ({USABLE}) AS host, min(page_id) FILTER ({USABLE}) AS rank FROM q GROUP BY 1",
    "dedupe_union": f"WITH l AS (SELECT page_id, url, 1 AS leg FROM pages UNION ALL SELECT page_id + 100000, url || '/', 2 FROM pages WHERE page_id % 2 = 0), k AS (SELECT page_id % 5 AS institution, page_id, leg, {KEY} AS key FROM l) SELECT institution, key, page_id, leg FROM k QUALIFY row_number() OVER (PARTITION BY institution, key ORDER BY leg, page_id) = 1",
    "site_queries": "SELECT s_suppkey, term, 'site:s' || s_suppkey || '.gov ' || term AS site_query, '\"' || s_name || '\" ' || term AS open_query FROM supplier CROSS JOIN (VALUES ('artificial intelligence'), ('chatbot')) t(term)",
    "found_by_union": "SELECT 'u' || (page_id % 60) AS link, min(page_id) AS first, string_agg(DISTINCT 'q' || (page_id % 7), '|' ORDER BY 'q' || (page_id % 7)) AS found_by FROM pages GROUP BY 1",
    "url_dates": "WITH x AS (SELECT page_id, '20' || lpad(CAST(page_id % 30 AS VARCHAR), 2, '0') AS y, page_id % 15 AS m, page_id % 33 AS d FROM pages) SELECT page_id, CASE WHEN m NOT BETWEEN 1 AND 12 THEN '' WHEN page_id % 2 = 1 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') WHEN try_cast(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) IS NULL THEN '' ELSE y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') END AS dates FROM x",
    "iso_partial_period": "WITH p AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS partial FROM orders), q AS (SELECT *, CAST(partial || CASE length(partial) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END AS DATE) AS f FROM p), r AS (SELECT *, CASE length(partial) WHEN 4 THEN CAST(partial || '-12-31' AS DATE) WHEN 7 THEN last_day(f) ELSE f END AS l FROM q) SELECT o_orderkey, partial, CAST(f AS VARCHAR) AS first_day, CAST(l AS VARCHAR) AS last_day, l >= DATE '1990-01-01' AND f <= DATE '1997-06-15' AS in_window FROM r",
    "run_id_times": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS started FROM orders",
    "readability_letter_share": "WITH s AS (SELECT doc_id, text, length(regexp_replace(text, '[^\\p{L}\\p{M}]', '', 'g')) / nullif(length(regexp_replace(text, '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')), 0) AS share FROM documents) SELECT doc_id, round(share, 4) AS share, CASE WHEN share < 0.1 THEN 'low_letter_share' END AS failure FROM s",
    "near_empty": "SELECT lang, count(*) FILTER (length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 200) AS n_near_empty, count(*) AS n FROM documents GROUP BY 1",
    "cap_text": "WITH c AS (SELECT doc_id, text, CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 500) || chr(10) || chr(10) || '[... ' || format('{:,}', length(text) - 1000) || ' of the page''s characters left out to fit 1,000 ...]' || chr(10) || chr(10) || right(text, 500) END AS c FROM documents) SELECT doc_id, md5(left(c, 500) || '|' || right(c, 500)) AS ends, length(text) > 1000 AS truncated, length(c) AS n FROM c",
    "email_domain_counts": "WITH e AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'), lambda x: lower(x)))) AS e FROM documents), d AS (SELECT doc_id, split_part(e, '@', -1) AS domain, count(*) AS n FROM e GROUP BY 1, 2) SELECT domain, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_docs FROM d GROUP BY 1",
    "word_presence": f"WITH b AS (SELECT item_id, unnest(list_distinct({WORDS})) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), d AS (SELECT doc_id, lang, unnest(list_distinct({WORDS})) AS w FROM documents WHERE n_chars < 3000), k AS (SELECT item_id, lang, doc_id, count(*) AS k FROM d JOIN b USING (w) GROUP BY 1, 2, 3) SELECT item_id, lang, round(max(k / n), 4) AS presence FROM k JOIN n USING (item_id) GROUP BY 1, 2",
    "quote_window": "WITH q AS (SELECT doc_id, text, instr(text, substr(text, 301, 40)) AS pos FROM documents WHERE length(text) > 400) SELECT doc_id, md5(substr(text, greatest(pos - 50, 1), 40 + (pos - greatest(pos - 50, 1)) + 50)) AS \"window\" FROM q",
    "token_estimate": "SELECT lang, CAST(sum(ceil(strlen(coalesce(text, '')) * 0.25 - 1e-9)) AS BIGINT) AS tokens FROM documents GROUP BY 1",
    "chunks_are_lossless": "SELECT doc_id, md5(text) AS again FROM documents WHERE text <> ''",
    "chunk_pages": r"WITH p AS (SELECT doc_id, regexp_extract_all(text, '(?s)(?:.{1,750}.{0,750}(?:[\s\x0B]|$)|.{1,750}.{0,750})') AS p FROM documents WHERE text <> '') SELECT doc_id, len(p) AS parts, CAST(list_sum(list_transform(p, lambda x: length(x))) AS BIGINT) AS chars FROM p",
    "year_candidates": "WITH t AS (SELECT coalesce(text, '') || ' in ' || (2010 + doc_id % 25) || ' and 12345, 2020.' || coalesce(' ' || lang, '') AS t FROM documents), y AS (SELECT unnest(list_filter(string_split_regex(t, '[^0-9]+'), lambda x: length(x) = 4)) AS y FROM t) SELECT CAST(y AS INTEGER) AS year, count(*) AS n FROM y WHERE y BETWEEN '2015' AND '2030' GROUP BY 1",
    "greedy_pack": """WITH RECURSIVE o AS (SELECT source, doc_id, coalesce(n_chars, 0) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id, coalesce(n_chars, 0)) AS nth FROM documents),
      w AS (SELECT source, doc_id, nth, 0 AS chunk, s AS used, 1 AS n FROM o WHERE nth = 1
        UNION ALL SELECT o.source, o.doc_id, o.nth, w.chunk + CASE WHEN w.used + o.s > 20000 OR w.n >= 8 THEN 1 ELSE 0 END, CASE WHEN w.used + o.s > 20000 OR w.n >= 8 THEN o.s ELSE w.used + o.s END, CASE WHEN w.used + o.s > 20000 OR w.n >= 8 THEN 1 ELSE w.n + 1 END
        FROM w JOIN o ON o.source IS NOT DISTINCT FROM w.source AND o.nth = w.nth + 1)
      SELECT source, doc_id, CAST(chunk AS INTEGER) AS chunk FROM w""",
    "keyword_proximity": r"""WITH l AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w FROM documents),
      u AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM l), k AS (SELECT doc_id, i, regexp_replace(lower(w), '[^\p{L}\p{M}\p{N}_]+', '', 'g') AS w FROM u),
      f AS (SELECT doc_id, i, CASE WHEN contains(w, 'ttion') THEN 1 WHEN contains(w, 'wher') THEN 2 END AS k FROM k WHERE contains(w, 'ttion') OR contains(w, 'wher')),
      g AS (SELECT doc_id, k <> lag(k) OVER o AND i - lag(i) OVER o <= 30 AS hit FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i))
      SELECT doc_id, coalesce((SELECT bool_or(hit) FROM g WHERE g.doc_id = d.doc_id), false) AS near FROM documents d""",
    "shingle_jaccard_pairs": SHINGLES + "SELECT a, b, CAST(shared AS INTEGER) AS shared, CAST(united AS INTEGER) AS united FROM pairs",
    "near_duplicate_groups": SHINGLES + ", e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(key, root) AS (SELECT key, key FROM firsts UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.key) SELECT w.key AS key, CASE WHEN len(w.w) < 5 THEN w.key ELSE min(root) END AS group_key, len(w.w) < 5 AS short FROM w JOIN firsts f ON f.w = w.w JOIN r ON r.key = f.key GROUP BY w.key, w.w",
    "independence_groups": "WITH RECURSIVE s AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN 'gc' || (n_chars % 997) END AS g, 'uk' || (doc_id % 613) AS u FROM documents), k AS (SELECT id, unnest([g, u]) AS k FROM s WHERE g IS NOT NULL), f AS (SELECT k, min(id) AS v FROM k GROUP BY 1), e AS (SELECT id AS a, v AS b FROM k JOIN f USING (k) UNION SELECT v, id FROM k JOIN f USING (k)), r(id, root) AS (SELECT id, id FROM s WHERE g IS NOT NULL UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT s.id AS source_id, min(root) AS group_id FROM s LEFT JOIN r USING (id) GROUP BY 1",
}


def html_main_text(spark, sf):
    from ..functions import html

    return html.extract(table(spark, sf, "pages")).select(F.col("key").alias("page_id"), F.length("main_text").alias("n_main"), F.length("chrome_text").alias("n_chrome"), F.md5("main_text").alias("digest"))


def html_links(spark, sf):
    from ..functions import html

    return html.extract(table(spark, sf, "pages")).select(F.explode("links").alias("l")).groupBy(urls.site_host(F.col("l.url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


QUERIES |= {"html_main_text": html_main_text, "html_links": html_links}


def registrable_domains(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit(".co.uk:81/x"))).otherwise(F.col("url")).alias("url"))
    return p.select("page_id", urls.registrable_domain(F.col("url")).alias("domain"))


def language_id(spark, sf):
    from ..functions import language

    d = table(spark, sf, "documents").select("lang", language.identify(F.col("text")).alias("found"))
    return d.groupBy("lang", "found").agg(F.count(F.lit(1)).alias("n"))


def mined_years(spark, sf):
    from ..functions import years

    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("FY"), (F.col("doc_id") % 90 + 10).cast("string"), F.lit(" and "), (F.col("doc_id") % 40 + 1990).cast("string"), F.lit("-2020, "), F.coalesce("text", F.lit(""))).alias("text"))
    return years.year_rows(d, "doc_id", "text", 2026).groupBy("year", "form").agg(F.count(F.lit(1)).alias("n"))


def halved_parts(spark, sf):
    def send(piece: str) -> str:
        if len(piece) > 800:
            raise packing.OverLimit
        return str(len(piece))

    out = packing.with_halving(table(spark, sf, "documents"), "doc_id", "text", send)
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("pieces"), F.count_if("failed").alias("n_failed"), F.sum(F.col("result").cast("long")).alias("sent"))


QUERIES |= {"registrable_domains": registrable_domains, "language_id": language_id, "mined_years": mined_years, "halved_parts": halved_parts}
ORACLES |= {
    "registrable_domains": "WITH h AS (SELECT page_id, string_split(" + HOST + " || CASE WHEN page_id % 3 = 0 THEN '.co.uk' ELSE '' END, '.') AS l FROM pages) SELECT page_id, array_to_string(l[len(l) - CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END :], '.') AS domain FROM h",
}
