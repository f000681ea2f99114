"""Text measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"

# Page limits and readability cuts.
NEAR_EMPTY_CHARS, CAP_CHARS, LETTER_SHARE_CUT, HEAD_CHARS = 50, 60_000, 0.10, 1024


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), f"{SPACE}+"), lambda w: w != "")


def shingles(words_: Column, n: int = 5) -> Column:
    """The set of n-word shingles; empty below n words."""
    last = F.size(words_) - n
    every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words_, i + 1, n), " "))
    return F.when(last >= 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def is_near_empty(text: Column, least: int = NEAR_EMPTY_CHARS) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < least


def letter_share(text: Column) -> Column:
    """Letters and marks over characters that are not white space; null where there are none."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))
    return F.try_divide(letters, F.length(F.regexp_replace(text, f"{SPACE}+", "")))


def binary_markers(text: Column) -> Column:
    """Names of the binary markers found, in a fixed order."""
    # The marker strings, and how far they are looked for.
    head = F.substring(text, 1, HEAD_CHARS)
    objects = F.regexp_count(F.substring(text, 1, 200_000), F.lit(r"\b(?:\d+ \d+ obj|endobj|endstream|stream)\b"))
    image = F.lit(False)
    for magic in ("\x89PNG", "JFIF", "Exif\x00", "GIF87a", "GIF89a"):
        image = image | head.contains(magic)
    return F.array_compact(
        F.array(
            F.when(head.contains("%PDF-"), "pdf_header"),
            F.when(objects >= 3, "pdf_objects"),
            F.when(head.contains("PK\x03\x04"), "zip"),
            F.when(text.contains("\x00"), "null"),
            F.when(image, "image"),
        )
    )


def readability_failure(text: Column, share: Column | None = None) -> Column:
    """Why a text can't be read, null where it can or is blank; ``share``: its letter_share, where a caller has it already."""
    markers = binary_markers(text)
    share = letter_share(text) if share is None else share
    return (
        F.when(~text.rlike(f"[^{SPACE[1:]}"), None)
        .when(F.size(markers) > 0, F.concat(F.lit("binary_marker:"), F.array_join(markers, ",")))
        .when(share < LETTER_SHARE_CUT, "low_letter_share")
    )


def capped(text: Column, most: int = CAP_CHARS, rule: str = "head_tail") -> Column:
    """The text, or its head (and tail) with a marker that counts what was left out."""
    left_out = F.format_number(F.length(text) - most, 0)
    marker = F.concat(F.lit("\n\n[... "), left_out, F.lit(f" of the page's characters left out to fit {most:,} ...]\n\n"))
    head = most if rule == "head" else most // 2
    tail = F.lit("") if rule == "head" else F.substring(text, -(most - head), most - head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), marker, tail))


def keywords_near(text: Column, keywords: tuple[str, ...], distance: int = 50) -> Column:
    """Whether two different keywords stand within ``distance`` words; a word counts for the first keyword it holds."""
    clean = F.transform(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), lambda w: F.lower(F.regexp_replace(w, r"(?U)\W+", "")))

    def of(word: Column) -> Column:
        out = F.lit(None).cast("string")
        for k in reversed(keywords):
            out = F.when(word.contains(k), k).otherwise(out)
        return out

    found = F.filter(F.transform(clean, lambda w, i: F.struct(i.alias("at"), of(w).alias("k"))), lambda s: s["k"].isNotNull())
    # Of two different keywords at the least distance no third stands between, so neighbours and the runs between decide.
    step = F.aggregate(
        found,
        F.struct(F.lit(None).cast("string").alias("k"), F.lit(-1).alias("at"), F.lit(False).alias("hit")),
        lambda acc, s: F.struct(s["k"].alias("k"), s["at"].alias("at"), (acc["hit"] | (acc["k"].isNotNull() & (acc["k"] != s["k"]) & (s["at"] - acc["at"] <= distance))).alias("hit")),
        lambda acc: acc["hit"],
    )
    return F.coalesce(step, F.lit(False))


def emails(text: Column) -> Column:
    """Lower-cased distinct addresses in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"), 1)
    return F.array_distinct(F.transform(found, lambda e: F.lower(e)))


def email_domains(addresses: Column) -> Column:
    """array<struct<domain,n>> sorted by domain."""
    domains = F.transform(addresses, lambda e: F.substring_index(e, "@", -1))
    return F.transform(F.array_sort(F.array_distinct(domains)), lambda d: F.struct(d.alias("domain"), F.size(F.filter(domains, lambda x: x == d)).alias("n")))


def word_presence(quote: Column, source: Column) -> Column:
    """Share of the quote's words that the source holds; null for an empty quote."""
    q, s = words(quote), words(source)
    return F.try_divide(F.size(F.filter(q, lambda w: F.array_contains(s, w))), F.size(q))


def window_around(quote: Column, source: Column, chars: int = 200) -> Column:
    """The quote with ``chars`` characters on both sides; null where it does not stand in the source."""
    start = F.instr(source, quote)
    first = F.greatest(start - chars, F.lit(1))
    return F.when(start > 0, F.substring(source, first, F.length(quote) + (start - first) + chars))


def flags_union(flag_sets: Column) -> Column:
    """Sorted union of ';'-joined flag sets, 'none' where nothing is left."""
    flat = F.flatten(F.transform(flag_sets, lambda s: F.transform(F.split(s, ";"), lambda f: F.trim(f))))
    kept = F.array_sort(F.array_distinct(F.filter(flat, lambda f: f.isNotNull() & (f != "") & (f != "none"))))
    return F.when(F.size(kept) > 0, F.array_join(kept, ";")).otherwise("none")
