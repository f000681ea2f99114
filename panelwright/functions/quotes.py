"""Whether a quote stands in the text it came from: word presence, or the similarity of the token sets."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two rules' thresholds.
MATCH_THRESHOLD, WORD_SHARE = 93.0, 0.80
_WORD = regex.compile(r"[^\W_](?:[^\W_]|[\p{Mn}\p{Mc}])*(?:['’][^\W_](?:[^\W_]|[\p{Mn}\p{Mc}])*)*")


def word_tokens(text: str) -> list[str]:
    """Word runs of the NFKC, case-folded text: letters and digits with their marks, joined over apostrophes."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of rows at a time."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & places.get(c, 0)
        rows = (rows + hit | rows - hit) & full
    return len(a) - rows.bit_count()


def token_set_ratio(a: list[str], b: list[str]) -> float:
    """0 to 100: the best similarity among shared words, and shared words with each side's rest, as sorted sets."""
    x, y = set(a), set(b)
    if not x or not y:
        return 0.0
    both, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    n, gap = len(both), bool(both)
    len_a, len_b = n + gap + len(only_a), n + gap + len(only_b)
    apart = len(only_a) + len(only_b) - 2 * common_subsequence(only_a, only_b)
    best = 1 - apart / (len_a + len_b)
    if both:
        best = max(best, 1 - (gap + len(only_a)) / (n + len_a), 1 - (gap + len(only_b)) / (n + len_b))
    return 100 * best


def matched(quote: str | None, source: str | None) -> tuple[float, float | None, str | None]:
    """(score, word share, decided_by): decided_by is matcher, word_rule, both, or null where neither rule passes."""
    q, s = word_tokens(quote or ""), word_tokens(source or "")
    if not q:
        return 0.0, None, None
    held = set(s)
    share, score = sum(w in held for w in q) / len(q), round(token_set_ratio(q, s), 2)
    by_score, by_words = score >= MATCH_THRESHOLD, share >= WORD_SHARE
    return score, round(share, 4), "both" if by_score and by_words else "matcher" if by_score else "word_rule" if by_words else None


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("word_share", T.DoubleType()), T.StructField("decided_by", T.StringType())]))
def match_quote(quote: pd.Series, source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([matched(q, s) for q, s in zip(quote, source)], columns=["score", "word_share", "decided_by"])
