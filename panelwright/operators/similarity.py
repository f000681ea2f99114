"""Similarity join on shingle sets, with lossless candidate generation.

Two sets with Jaccard of at least 4/5 share a shingle among the rarest
|S| - ceil(4/5 |S|) + 1 of each, and their sizes differ by at most that
ratio. So only these prefixes are joined; every candidate is then checked
in integers on the whole sets. Shingles stand for their 64-bit hashes. Texts
of equal words (by a 128-bit digest) are one row from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import text as T
from .components import components

NUM, DEN, WORDS = 4, 5, 5


def _cut_texts(docs: DataFrame, scope: str | None) -> DataFrame:
    """(key, scope, digest, s): each text's sorted set of hashed shingles, null under five words; texts are read once."""
    rows = docs.select("key", (F.col(scope) if scope else F.lit(0)).alias("scope"), T.words(F.coalesce("text", F.lit(""))).alias("w"))
    hashed = rows.select("key", "scope", F.md5(F.array_join("w", " ")).alias("digest"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    each = F.transform(F.sequence(F.lit(0), F.size("h") - WORDS), lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(WORDS)]))
    return cut(hashed.select("key", "scope", "digest", F.when(F.size("h") >= WORDS, F.array_sort(F.array_distinct(each))).alias("s")))


def _sets(texts: DataFrame) -> DataFrame:
    """One row per scope and digest: its least key and its set."""
    least = texts.where("s IS NOT NULL").groupBy("scope", "digest").agg(F.min("key").alias("key"))
    return cut(texts.join(least, ["scope", "digest", "key"], "left_semi").select("scope", "key", "s"))


def _prefixes(sets: DataFrame) -> DataFrame:
    """(scope, key, n, h): of each set the rarest shingles that a similar set must share one of, those of one set alone left out."""
    each = sets.select("scope", "key", F.size("s").alias("n"), F.explode("s").alias("h"))
    shared = each.groupBy("scope", "h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # A shingle of one set alone joins nothing, but takes its place at the front of the prefix.
    common = each.join(shared, ["scope", "h"]).groupBy("scope", "key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("order"))
    longest = F.col("n") - F.ceil(F.col("n") * NUM / DEN).cast("int") + 1 - (F.col("n") - F.size("order"))
    return cut(common.where(longest > 0).select("scope", "key", "n", F.explode(F.slice("order", F.lit(1), longest)).alias("p")).select("scope", "key", "n", "p.h"))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(scope, a, b, shared, united) of the pairs that are similar."""
    left, right = sets.select("scope", F.col("key").alias("a"), F.col("s").alias("sa")), sets.select("scope", F.col("key").alias("b"), F.col("s").alias("sb"))
    met = pairs.join(left, ["scope", "a"]).join(right, ["scope", "b"]).withColumn("shared", F.size(F.array_intersect("sa", "sb"))).withColumn("united", F.size("sa") + F.size("sb") - F.col("shared"))
    return met.where(F.col("shared") * DEN >= F.col("united") * NUM).select("scope", "a", "b", "shared", "united")


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * DEN >= F.greatest(a, b) * NUM


def similar_pairs(docs: DataFrame, scope: str | None = None) -> DataFrame:
    """(scope, a, b, shared, united) with a < b for the keys of docs (key, text) whose 5-word shingle sets have 5 |A n B| >= 4 |A u B|.

    Keys must be unique; texts under five words have no pair. scope: a column
    within which alone pairs count. Rows of equal text are all paired through
    their least key only (their links are implied).
    """
    sets = _sets(_cut_texts(docs, scope))
    prefix = _prefixes(sets)
    a, b = prefix.alias("a"), prefix.alias("b")
    near = (F.col("a.scope") == F.col("b.scope")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.key") < F.col("b.key")) & _sizes_fit(F.col("a.n"), F.col("b.n"))
    return _checked(a.join(b, near).select(F.col("a.scope").alias("scope"), F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct(), sets)


def near_duplicate_groups(docs: DataFrame, scope: str | None = None) -> DataFrame:
    """(key, group_key, short): components of similar pairs, named by their least key; short texts are flagged singletons.

    Groups need links, not all pairs: the holders of a shingle are first
    checked against one of them, the pivot; only holders whose groups still
    differ are then paired.
    """
    texts = _cut_texts(docs, scope)
    sets = _sets(texts)
    prefix = _prefixes(sets)
    pivots = prefix.groupBy("scope", "h").agg(F.min(F.struct("key", "n")).alias("pivot"))
    stars = prefix.join(pivots, ["scope", "h"]).where((F.col("key") > F.col("pivot.key")) & _sizes_fit(F.col("n"), F.col("pivot.n"))).select("scope", F.col("pivot.key").alias("a"), F.col("key").alias("b")).distinct()
    links = cut(_checked(stars, sets).select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = prefix.join(components(links).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    a, b = placed.alias("a"), placed.alias("b")
    apart = (F.col("a.scope") == F.col("b.scope")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & _sizes_fit(F.col("a.n"), F.col("b.n"))
    across = _checked(a.join(b, apart).select(F.col("a.scope").alias("scope"), F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct(), sets)
    found = components(links.union(across.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    least = texts.where("s IS NOT NULL").groupBy("scope", "digest").agg(F.min("key").alias("first"))
    named = texts.join(least, ["scope", "digest"], "left").select("key", F.coalesce("first", "key").alias("first"), F.col("s").isNull().alias("short"))
    return named.join(found.withColumnRenamed("node", "first"), "first", "left").select("key", F.coalesce("root", "first").alias("group_key"), "short")


def independence_groups(rows: DataFrame) -> DataFrame:
    """(source_id, group_id): components of "shares its copy group or its URL key"; rows lacking either are refused (null group)."""
    whole = rows.where("copy_group IS NOT NULL AND url_key IS NOT NULL")
    keys = whole.select("source_id", F.explode(F.array(F.concat(F.lit("g"), "copy_group"), F.concat(F.lit("u"), "url_key"))).alias("k"))
    first = keys.groupBy("k").agg(F.min("source_id").alias("v"))
    found = components(keys.join(first, "k").select(F.col("source_id").alias("u"), "v"))
    return rows.select("source_id").join(found.select(F.col("node").alias("source_id"), F.col("root").alias("group_id")), "source_id", "left")
