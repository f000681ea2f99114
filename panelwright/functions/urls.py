"""URL identity, host classes and URL screening as Column expressions.

Identity has three levels: the exact string, the path-aware key, the site
root. Every function gives null or an empty string for what cannot be read as
a URL; none raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"

# Hosts that never are an institution's own site.
AGGREGATORS = (
    "wikipedia.org", "wikimedia.org", "wikiwand.com", "dbpedia.org", "facebook.com", "instagram.com", "linkedin.com",
    "twitter.com", "x.com", "youtube.com", "tiktok.com", "pinterest.com", "reddit.com", "crunchbase.com", "bloomberg.com",
    "glassdoor.com", "indeed.com", "yelp.com", "tripadvisor.com", "mapquest.com", "google.com", "bing.com", "amazon.com",
    "scribd.com", "issuu.com", "slideshare.net", "academia.edu", "researchgate.net",
)
# Host prefixes of mail and infrastructure endpoints.
INFRASTRUCTURE = ("autodiscover.", "webmail.", "mail.", "smtp.", "imap.", "mx.", "cpanel.", "webdisk.")
# Hosts of the two host rules.
SHORTENERS = ("bit.ly", "buff.ly", "cutt.ly", "dlvr.it", "goo.gl", "is.gd", "lnkd.in", "ow.ly", "rebrand.ly", "shorturl.at", "t.co", "tinyurl.com", "trib.al")
SOCIAL = ("facebook.com", "instagram.com", "linkedin.com", "t.me", "threads.net", "tiktok.com", "twitter.com", "vk.com", "weibo.com", "x.com")
LINKEDIN_PROFILES = ("company", "in", "school", "showcase")
# The path rules, on the lower-cased path.
_ENDS = r"(?:/|$|\.(?:php|aspx|html?|jsp)(?:/|$))"
PATH_RULES = (
    ("robots_txt", r"(?:^|/)robots\.txt$"),
    ("sitemap", r"(?:^|/)sitemap[a-z0-9._-]*\.(?:xml|php|aspx|html?|jsp)$"),
    ("calendar_feed", r"\.(?:ics|rss|atom)$|(?:^|/)(?:feed|rss|atom)/?$"),
    ("login_auth", r"(?:^|/)(?:login|log-in|signin|sign-in|signup|sign-up|logout|log-out|oauth|sso)" + _ENDS + r"|wp-login\.php$"),
    ("search_results", r"(?:^|/)(?:search|search-results)" + _ENDS),
)
SEARCH_QUERY = r"(?:^|&)(?:query|search)="


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def site_host(url: Column) -> Column:
    """Lower-cased host with its port, without user info and ``www.``; null where there is none."""
    host = F.regexp_replace(F.regexp_replace(F.lower(authority(url)), r"^.*@", ""), r"^www\.", "")
    return F.when(host != "", host)


def site_root(url: Column) -> Column:
    return F.concat(F.lit("https://"), site_host(url), F.lit("/"))


def host_of(url: Column) -> Column:
    """Lower-cased authority without ``www.``; empty where there is none."""
    return F.regexp_replace(F.lower(F.coalesce(authority(url), F.lit(""))), r"^www\.", "")


def exact_host(url: Column) -> Column:
    """Host with ``www.`` kept; a URL without ``//`` is read as https."""
    whole = F.when(url.contains("//"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(F.lower(authority(whole)), r"^.*@", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_of(url: Column) -> Column:
    """The path without trailing slashes; empty for a root."""
    whole = F.when(url.contains("//"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(path(whole), r"/+$", "")


def dedupe_key(url: Column) -> Column:
    """Path-aware key: scheme and host lower-cased, no ``www.``, no fragment, one trailing slash stripped, query kept."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    where = F.regexp_replace(path(url), r"/(;[^/]*)?$", "$1")
    asked = query(url)
    key = F.concat(scheme, F.lit("://"), F.regexp_replace(F.lower(authority(url)), r"^www\.", ""), where, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))
    return F.when((scheme == "") | (authority(url) == ""), url).otherwise(key)


def url_hash(url: Column) -> Column:
    return F.md5(url)


def shard_of(key: Column) -> Column:
    """The first two hex digits of the key's md5: 256 shards."""
    return F.substring(F.md5(key), 1, 2)


def _host_in(host: Column, roster: tuple[str, ...]) -> Column:
    return host.isin(*roster) | host.rlike(r"\.(?:" + "|".join(r.replace(".", r"\.") for r in roster) + ")$")


def is_aggregator(host: Column) -> Column:
    return (host == "") | _host_in(host, AGGREGATORS)


def is_infrastructure(host: Column) -> Column:
    return host.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in INFRASTRUCTURE) + ")")


def is_usable_domain(host: Column) -> Column:
    return (host != "") & host.contains(".") & ~is_aggregator(host) & ~is_infrastructure(host)


def screen_rules(url: Column) -> Column:
    """Sorted names of the rules that a URL trips; empty means it passes, as does what is no URL."""
    host = F.regexp_replace(F.regexp_replace(F.lower(authority(url)), ":.*$", ""), r"^www\.", "")
    where, asked = F.lower(path(url)), F.lower(query(url))
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    linkedin = _host_in(host, ("linkedin.com",))
    profile = F.when(linkedin, (F.size(segments) == 2) & F.get(segments, F.lit(0)).isin(*LINKEDIN_PROFILES)).otherwise(F.size(segments) <= 1)
    hits = [F.when(where.rlike(rule), F.lit(name)) for name, rule in PATH_RULES if name != "search_results"]
    hits.append(F.when(where.rlike(dict(PATH_RULES)["search_results"]) | asked.rlike(SEARCH_QUERY), F.lit("search_results")))
    hits.append(F.when(_host_in(host, SHORTENERS), F.lit("url_shortener")))
    hits.append(F.when(_host_in(host, SOCIAL) & profile, F.lit("social_media_profile")))
    return F.array_sort(F.array_compact(F.array(*hits)))


def screen(url: Column) -> Column:
    """struct(decision, matched_rules, reason)."""
    rules = screen_rules(F.coalesce(url, F.lit("")))
    dropped = F.size(rules) > 0
    return F.struct(F.when(dropped, "drop").otherwise("pass").alias("decision"), rules.alias("matched_rules"), F.when(dropped, "url_pattern_noncontent").alias("reason"))


def site_query(query_text: Column, domain: Column) -> Column:
    return F.concat(F.lit("site:"), domain, F.lit(" "), query_text)


def phrase(value: Column) -> Column:
    """The value in quotation marks, with its own removed."""
    return F.concat(F.lit('"'), F.regexp_replace(value, '"', ""), F.lit('"'))


def hint(value: Column) -> Column:
    """A query hint: no quotes or parentheses, no leading minus of a word, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(value, r'["()]', " "), r"(^|\s)-+", "$1")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


#: Two-label public suffixes known without a suffix table; callers with the full public list pass it.
SUFFIXES = (
    "co.uk", "gov.uk", "ac.uk", "org.uk", "com.au", "gov.au", "edu.au", "co.jp", "go.jp", "ac.jp", "com.br", "gov.br", "co.in", "gov.in", "nic.in",
    "com.mx", "gob.mx", "com.cn", "gov.cn", "co.za", "gov.za", "co.kr", "go.kr", "com.tr", "gov.tr", "co.nz", "govt.nz",
)


def registrable_domain(url_or_host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The label before the longest known public suffix, with it; a single label or an address in numbers stays as it is."""
    host = F.regexp_replace(F.coalesce(site_host(url_or_host), F.lower(url_or_host)), ":[0-9]+$", "")
    known = "|".join(x.replace(".", r"\.") for x in suffixes)
    return F.when(host.rlike(r"^[^.]*$|^[0-9.]+$"), host).otherwise(F.regexp_extract(host, rf"([^.]+\.(?:{known}|[^.]+))$", 1))
