"""Language of a text by the share of its function words: a plug-in for engines with a real identifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

MIN_LETTERS, SHARE = 200, 0.5
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "be", "by", "this", "are", "from"),
    "fr": ("le", "la", "les", "des", "et", "en", "une", "du", "dans", "pour", "que", "qui", "est", "au", "avec"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "im", "des", "auf", "für", "nicht", "ein"),
    "es": ("el", "los", "las", "del", "que", "por", "con", "una", "para", "es", "se", "no", "su", "al", "lo"),
}


def identify(text: Column) -> Column:
    """The language whose function words are over half of all those found; 'mul' where none is; 'unknown' under 200 letters or without any."""
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", ""))
    # Only function words are kept, so the arrays compared are short.
    every = sorted({w for ws in STOP_WORDS.values() for w in ws})
    words = F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), T.SPACE + "+"), lambda w: F.regexp_replace(w, r"[^\p{L}]", "")), lambda w: w.isin(*every))
    among = lambda ws: lambda w: w.isin(*ws)
    once = lambda column, then: F.get(F.transform(F.array(column), then), F.lit(0))  # noqa: E731  (binds a value, so that it is computed once)
    hits = once(words, lambda found: F.array(*[F.size(F.filter(found, among(ws))) for ws in STOP_WORDS.values()]))
    codes = F.array(*[F.lit(c) for c in STOP_WORDS])

    def decided(h: Column) -> Column:
        total, best = F.aggregate(h, F.lit(0), lambda a, x: a + x), F.array_max(h)
        return F.when(total == 0, "unknown").when(best > SHARE * total, F.get(codes, F.array_position(h, best).cast("int") - 1)).otherwise("mul")

    return F.when(letters < MIN_LETTERS, "unknown").otherwise(once(hits, decided))
