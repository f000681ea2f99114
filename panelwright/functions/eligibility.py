"""Row, URL and text predicates: who belongs to a frame, which addresses count, which texts carry a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .urls import exact_host, is_infrastructure, registrable_domain

# What marks a name collision, a blank website, a site that is no institution's own.
COLLISION = ("1", "true", "t", "yes", "y")
BLANK_WEBSITES = ("TBD",)
NOT_OWN_SITES = ("data.ipu.org", "wikipedia.org", "wikimedia.org")
PLACEHOLDERS = ("tbd", "none")
MIN_WEBSITE_CHARS = 5
# Hosts of archives, and hosts that are one under a path only.
ARCHIVES = (
    "web.archive.org", "wayback.archive.org", "archive.ph", "archive.is", "archive.today", "archive.li", "archive.md", "archive.vn", "archive.fo", "webcache.googleusercontent.com",
)
ARCHIVE_PATHS = {"archive.org": "/details/"}
# Review states of pages that were not reviewed, HTTP statuses that are refusals.
UNREVIEWED = ("fetch_failed", "no_usable_text", "link_not_followed_cap", "link_not_followed_hops")
REFUSALS = (401, 403, 406, 451)
# Acronyms that count in capitals only, phrases that count in any case.
ACRONYMS = ("AI", "LLM")
PHRASES = (
    "artificial intelligence", "generative ai", "genai", "gen ai", "chatgpt", "chat gpt", "large language model", "machine learning", "chatbot", "copilot",
    "intelligence artificielle", "inteligencia artificial", "inteligência artificial", "künstliche intelligenz", "intelligenza artificiale",
)


def _false(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def has_colliding_name(duplicate: Column) -> Column:
    """The cell says that another institution has the same name; both are kept, so this is no eligibility test."""
    return _false(F.lower(T.strip(duplicate)).isin(*COLLISION))


def website_host(website: Column) -> Column:
    """The host of a website cell, with or without a scheme; null without a dot."""
    rest = F.when(website.contains("//"), F.regexp_extract(website, r"^[^/]*//([^/?#]*)", 1)).otherwise(F.regexp_extract(website, r"^([^/?#]*)", 1))
    host = F.lower(F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), ":[0-9]*$", ""))
    return F.when(host.contains("."), host)


def is_placeholder(website: Column) -> Column:
    """The cell holds a reference site, a placeholder word, or n/a on its own."""
    low = F.lower(website)
    out = low.rlike("(?<![a-z0-9])n/a(?![a-z0-9])")
    for part in (*NOT_OWN_SITES, *PLACEHOLDERS):
        out = out | low.contains(part)
    return _false(out)


def is_eligible(website: Column) -> Column:
    """The website is long enough, has a host with a dot and is no placeholder."""
    bare = T.strip(F.coalesce(website, F.lit("")))
    return (F.length(bare) >= MIN_WEBSITE_CHARS) & website_host(bare).isNotNull() & ~is_placeholder(bare)


def website_blank(website: Column) -> Column:
    bare = T.strip(F.coalesce(website, F.lit("")))
    return (bare == "") | bare.isin(*BLANK_WEBSITES)


def archive_host(url: Column) -> Column:
    """The URL's host without a last dot and a leading www.; null where it has none."""
    authority = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.(?=.)", ""), F.lit(""))


def is_archive_address(url: Column) -> Column:
    """The host is an archive's, or an archive's under its path; false without a host."""
    host, path = archive_host(url), F.regexp_extract(F.trim(url), r"^[^/]*//[^/?#]*([^?#]*)", 1)
    out = host.isin(*ARCHIVES)
    for name, prefix in ARCHIVE_PATHS.items():
        out = out | ((host == name) & path.startswith(prefix))
    return _false(out)


def is_unreviewed(state: Column) -> Column:
    return _false(state.isin(*UNREVIEWED))


def is_refusal(status: Column) -> Column:
    """A status that another way of fetching may get around; no status at all is none."""
    return _false(status.isin(*REFUSALS))


def has_screen_signal(title: Column, snippet: Column, pattern: str, substrings: tuple[str, ...] = ()) -> Column:
    """Title and snippet hold a keyword (see keyword_pattern), one of the substrings, or gpt with a version; no text at all passes."""
    text = T.strip(F.regexp_replace(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))), f"{T.SPACE}+", " "))
    hit = text.rlike(pattern) | text.rlike(r"(?U)(?<!\w)gpt-?\d")
    for part in substrings:
        hit = hit | text.contains(part)
    return (text == "") | hit


def has_topic_signal(*fields: Column) -> Column:
    """A field holds an acronym in capitals between non-letters, or a phrase once separators are blanks."""
    out = F.lit(False)
    for field in fields:
        flat = F.regexp_replace(F.lower(field), "[-_/+.,:;]+", " ")
        hit = field.rlike("(?<![A-Za-z])(?:" + "|".join(ACRONYMS) + ")(?![A-Za-z])")
        for phrase in PHRASES:
            hit = hit | flat.contains(phrase)
        out = out | _false(hit)
    return out


def is_own_domain(url: Column, truth: Column, suffixes: Column | None = None) -> Column:
    """The URL stands on the institution's registrable domain, and not on a mail or infrastructure host."""
    host = F.regexp_replace(exact_host(url), r"^www\.", "")
    own = registrable_domain(host) if suffixes is None else domain_under(host, suffixes)
    return _false((truth != "") & (own == truth) & ~is_infrastructure(host))


def domain_under(host: Column, rules: Column) -> Column:
    """The registrable domain of a host by public-suffix rules, an array of strings: plain, wildcard (*.x) and exception (!y.x) rules.

    The longest rule wins, an exception over all; without any the last label
    is the suffix. Null where the host is itself a suffix or has no dot.
    """
    labels = F.split(F.lower(host), r"\.")
    tail = lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")
    at = F.sequence(F.lit(0), F.size(labels) - 1)
    excepted = F.filter(at, lambda i: F.array_contains(rules, F.concat(F.lit("!"), tail(i))))
    matched = F.filter(at, lambda i: F.array_contains(rules, tail(i)) | ((i < F.size(labels) - 1) & F.array_contains(rules, F.concat(F.lit("*."), tail(i + 1)))))
    start = F.when(F.size(excepted) > 0, F.get(excepted, F.lit(0)) + 1).when(F.size(matched) > 0, F.get(matched, F.lit(0))).otherwise(F.size(labels) - 1)
    return F.when((start > 0) & (F.size(labels) > 1) & ~host.rlike(r"^[0-9.]+$"), tail(start - 1))


def registrable_domains(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, domain) with a table of public-suffix rules (rule): every suffix of a host meets the rules in an equi-join, so the list may be of any size."""
    labels = F.split(F.lower(host), r"\.")
    names = hosts.select(host).distinct()
    tails = names.select(host, F.size(labels).alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("i", "tail"))
    plain = rules.where("NOT startswith(rule, '!') AND NOT startswith(rule, '*.')").select(F.col("rule").alias("tail"), F.lit(0).alias("shift"))
    wild = rules.where("startswith(rule, '*.')").select(F.expr("substring(rule, 3)").alias("tail"), F.lit(-1).alias("shift"))
    excepted = rules.where("startswith(rule, '!')").select(F.expr("substring(rule, 2)").alias("tail"), F.lit(1).alias("shift"))
    met = tails.join(plain.union(wild).union(excepted), "tail").withColumn("start", F.col("i") + F.col("shift")).where("start >= 0")
    best = met.groupBy(host).agg(F.coalesce(F.max(F.when(F.col("shift") == 1, F.col("start"))), F.min("start")).alias("start"))
    start = F.coalesce("start", F.size(labels) - 1)
    domain = F.array_join(F.slice(labels, start, F.size(labels)), ".")
    return names.join(best, host, "left").select(host, F.when((start > 0) & (F.size(labels) > 1) & ~F.col(host).rlike(r"^[0-9.]+$"), domain).alias("domain"))


def gate(answer: Column, opens: tuple[str, ...], stopped: Column) -> Column:
    """Whether a gated question is open: null where the gate's item was stopped, else whether its answer is one that opens it."""
    return F.when(~stopped, _false(answer.isin(*opens)))


def keeps(probability: Column, threshold: float = 0.5) -> Column:
    """A triage answer is kept from the threshold on; a missing probability is not."""
    return _false(probability >= threshold)


class NotRostered(ValueError):
    """Languages were asked for that the roster lacks."""


def require_rostered(wanted: DataFrame, roster: DataFrame, column: str = "language") -> DataFrame:
    """The wanted rows, unless the roster lacks any of their languages."""
    lacking = [r[0] for r in unrostered(wanted, roster, column).orderBy(column).limit(20).collect()]
    if lacking:
        raise NotRostered(f"not in the roster: {lacking}")
    return wanted


def unrostered(wanted: DataFrame, roster: DataFrame, column: str = "language") -> DataFrame:
    return wanted.select(column).distinct().join(roster.select(column), column, "left_anti")


def supported_observations(observations: DataFrame, checks: DataFrame, key: str = "observation") -> DataFrame:
    """(key, supported): an observation counts if it has checks and all of them passed."""
    passed = checks.groupBy(key).agg(F.bool_and(F.col("status") == "supported").alias("supported"))
    return observations.select(key).join(passed, key, "left").select(key, F.coalesce("supported", F.lit(False)).alias("supported"))


def open_failures(failures: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Failures whose stage has no artifact; with one they are ignored."""
    return failures.join(artifacts.select(*keys).distinct(), keys, "left_anti")
