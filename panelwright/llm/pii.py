"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping candidate spans (obfuscated mail
addresses, national phone numbers, IPv6, unspaced and short card numbers,
social-security-like numbers, credentials). Each candidate becomes a vector
of format and context features; boosted trees score it; a threshold per kind
selects what to redact: trees grow on three folds, are calibrated on a fourth,
and thresholds are set on the calibrated probabilities of the fifth;
overlaps go to the likeliest. The four base kinds, fixed by their patterns,
always stay and win every overlap.

No table holds PII labels, so the trees are trained on generated sentences
(``training_set``: fixed seed, ``TRAIN_SIZE`` sentences, a bounded size).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced, small_batches
from .trees import BoostedTrees

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "ssn")
TRAIN_SIZE, SEED, PRECISION = 4000, 20, 0.98

# The base patterns. Possessive repeats and a look-behind keep a long run of
# digits from being tried at each of its places; they match the same spans.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind as in BASE_KINDS, then start; code points, end exclusive."""
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    out += (("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m[0].split(".")))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += (("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15)
    return out


# Generators: high recall, overlapping on purpose.
_AT = r"(?:\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)"
_DOT = r"(?:\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_OBFUSCATED = re.compile(rf"{_AT}[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)*{_DOT}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*|\s?[\[({{]\s?at\s?[\])}}]\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.I)
_OBFUSCATED_HINT = re.compile(r"[\[({]\s?at|dot", re.I)
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{12,}")


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    if _OBFUSCATED_HINT.search(text):
        last = 0  # no look-back reads what a match before it has read
        for m in _OBFUSCATED.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            last = m.end()
            if start < m.start():
                out.append(("email", start, m.end()))
    for m in _NUMBER.finditer(text):
        for kind in ("phone", "card", "ssn"):
            out.append((kind, *m.span()))
    if text.count(":") >= 2:
        out += (("ip", *m.span()) for m in _IPV6.finditer(text) if len(m[0]) > 4)
    for m in _TOKEN.finditer(text):
        start = m.start()
        if "=" in m[0].rstrip("="):  # password=..., token=...
            start += m[0].index("=") + 1
        if m.end() - start >= 8 and any(c.isdigit() for c in text[start : m.end()]):
            out.append(("secret", start, m.end()))
    return out


_CONTEXT = (
    ("email", re.compile(r"mail|contact|write|courriel|correo", re.I)),
    ("phone", re.compile(r"phone|tel|call|mobile|fax|appel|anruf", re.I)),
    ("ip", re.compile(r"\bip\b|host|server|address|adress", re.I)),
    ("card", re.compile(r"card|visa|pay|carte|karte|tarjeta", re.I)),
    ("secret", re.compile(r"password|passwd|pwd|token|secret|key|credential", re.I)),
    ("ssn", re.compile(r"ssn|social|insurance", re.I)),
    ("other", re.compile(r"version|\bv\b|isbn|order|invoice|page|\bno\b|ref|date|chapter|build|commit|sha", re.I)),
)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, left = text[start:end], text[max(0, start - 24) : start]
    digits = _digits(span)
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    letters = sum(c.isalpha() for c in span)
    counts = Counter(span)
    n = len(span)
    return [
        *(float(kind == k) for k in KINDS),
        min(end - start, 80), len(digits), letters / n, len(groups), groups[0] if groups else 0, groups[-1] if groups else 0, max(groups, default=0),
        sum(c in " ().-/" for c in span), span.count(":"), span.count("."), span.count("-"), span.count("/"), float(span[0] == "("), float("::" in span),
        float(13 <= len(digits) <= 19 and luhn(digits)), -sum(c / n * math.log2(c / n) for c in counts.values()),
        float(all(c in "0123456789abcdefABCDEF" for c in span)), float(any(c.islower() for c in span)), float(any(c.isupper() for c in span)),
        float(bool(re.search("dot|at[])}]", span, re.I))), float(span[:4] in ("AKIA", "ghp_", "sk-l", "xoxb")), float(bool(re.match("(?:19|20)[0-9]{2}(?![0-9])", span))), float(digits[:1] in ("3", "4", "5", "6")),
        float(left[-1:] == "="), float(left[-1:] in "'\"" and bool(left)), float(left.rstrip()[-1:] in ":="), float(text[end : end + 1].isalnum()),
        *(float(bool(p.search(left))) for _, p in _CONTEXT),
    ]


def training_set(size: int = TRAIN_SIZE, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with the spans that count as personal data."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("an", "er", "th", "ly", "io", "es", "ma", "ke", "lo", "ent", "bra", "un")) for _ in range(rng.randint(1, 4)))
    alnum = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def card(n: int, ok: bool) -> str:
        body = rng.choice("3456") + d(n - 2)
        return next(body + c for c in "0123456789" if luhn(body + c) == ok)

    made = {
        "email": lambda: f"{word()}.{d(2)}{rng.choice([' [at] ', '[at]', ' (at) ', ' at '])}{word()}{rng.choice([' [dot] ', ' dot ', '(dot)'])}{rng.choice(['com', 'org', 'net'])}",
        "phone": lambda: rng.choice([f"({d(3)}) 555-{d(4)}", f"{d(3)}-555-{d(4)}", f"{d(3)}.555.{d(4)}", f"0{d(2)} {d(4)} {d(4)}"]),
        "ip": lambda: rng.choice([":".join(hexa(4) for _ in range(8)), f"fe80::{hexa(4)}:{hexa(4)}", f"2001:db8::{hexa(3)}"]),
        "card": lambda: rng.choice([card(15, True), card(13, True), "-".join(re.findall("....", card(16, True)))]),
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "secret": lambda: rng.choice(["AKIA" + alnum(16).upper(), hexa(40), hexa(18), "ghp_" + alnum(30), alnum(24) + d(2)]),
    }
    clean = [lambda: f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", lambda: f"20{d(2)}/0{rng.randint(1, 9)}/1{d(1)} 12", lambda: d(rng.randint(7, 24)), lambda: f"{d(1)}.{d(2)}.{d(3)}.{d(4)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: " ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(4, 9))), lambda: card(16, False), lambda: f"{word()}_{word()}_{word()}{d(1)}", lambda: f"{word()}-{word()}-{word()}-{d(2)}", lambda: f"{word()} at {word()} dot", lambda: f"{d(4)}/{d(4)}/{d(2)}", lambda: word() + word() + word() + word() + d(2)]
    hints = {"email": ["mail", "contact"], "phone": ["call", "tel:", "phone"], "ip": ["host", "ip"], "card": ["card", "visa"], "ssn": ["ssn", "social security"], "secret": ["password=", "token = \"", "key:", "secret "]}
    out = []
    for _ in range(size):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 4))), []
        if rng.random() < 0.55:
            kind = rng.choice(list(made))
            lead = rng.choice(hints[kind]) if kind == "ssn" or rng.random() < 0.5 else word()
            text += f" {lead}" + ("" if lead[-1:] in "=\"" else " ")
            value = made[kind]()
            spans.append((kind, len(text), len(text) + len(value)))
            text += value
        else:
            text += f" {rng.choice(['version', 'order', 'no', 'isbn', word(), word(), 'page'])} {rng.choice(clean)()}"
        out.append((text + " " + word() + rng.choice([".", ",", ""]), spans))
    return out


class Spans:
    """Intervals of a text, kept apart and in order, so that one search tells whether another touches them."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def touches(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end

    def add(self, start: int, end: int) -> None:
        low, high = bisect_right(self.ends, start), bisect_left(self.starts, end)
        if low < high:
            start, end = min(start, self.starts[low]), max(end, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high] = [start], [end]


class Model:
    def __init__(self, trees: BoostedTrees, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def added(self, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """Per text the selected spans that touch no base span and not each other."""
        rows, found = [], []
        for k, text in enumerate(texts):
            taken = Spans()
            for _, start, end in base[k]:
                taken.add(start, end)
            for c in candidates(text):
                if not taken.touches(c[1], c[2]):
                    rows.append((k, c))
                    found.append(features(text, *c))
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if rows:
            chosen = [Spans() for _ in texts]
            p = self.trees.probability(np.array(found))
            for at in np.lexsort((np.arange(len(p)), -p)):
                k, (kind, start, end) = rows[at]
                if p[at] >= self.thresholds[kind] and not chosen[k].touches(start, end):
                    chosen[k].add(start, end)
                    out[k].append((kind, start, end))
        return out


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of training_set(): the same on every call and machine."""
    x, y, kinds = [], [], []
    for text, spans in training_set():
        for c in candidates(text):
            x.append(features(text, *c))
            y.append(float(any(c[0] == k and c[1] == s and c[2] == e for k, s, e in spans)))
            kinds.append(c[0])
    fx, fy = np.array(x), np.array(y)
    trees = BoostedTrees().fit(fx, fy)
    fold, p = np.arange(len(fy)) % 5 == 4, trees.probability(fx)
    thresholds = {}
    for kind in KINDS:  # the lowest threshold from 0.5 on that keeps the wanted precision on the held-back fold
        own = fold & np.array([k == kind for k in kinds])
        steps = [t for t in np.arange(0.5, 0.96, 0.05) if (picked := own & (p >= t)).any() and fy[picked].mean() >= PRECISION]
        thresholds[kind] = float(steps[0]) if steps else 0.95
    return Model(trees, thresholds)


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    out, last = [], 0
    merged: list[tuple[str, int, int]] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1] = (merged[-1][0], merged[-1][1], max(e, merged[-1][2]))
        else:
            merged.append((kind, s, e))
    for kind, s, e in merged:
        out += [text[last:s], f"[{kind.upper()}]"]
        last = e
    return "".join([*out, text[last:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_redacted: bool = False) -> DataFrame:
    """One row per document, in any order: the columns of SCHEMA, and ``redacted`` if asked for.

    Null texts count as empty and have no spans; repeated rows are rows of
    their own; an empty table gives no rows; other columns are not read.
    """
    model = trained()

    def score(batches):
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = model.added(texts, base)
            count = [Counter(k for k, _, _ in b) for b in base]
            columns = [batch.column(0), *([c[k] for c in count] for k in BASE_KINDS), [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], [joined(b + m) for b, m in zip(base, more)], [len(m) for m in more]]
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"]
            if with_redacted:
                columns.append([redacted(t, b + m) for t, b, m in zip(texts, base, more)])
                types.append(pa.string())
                names.append("redacted")
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(score, SCHEMA + (", redacted string" if with_redacted else ""))


def without_pii(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every selected span redacted, and the count of characters brought up to date.

    A null text stays null; a column of counts that is not there is not made.
    """
    model = trained()
    place = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def redact(batches):
        for batch in sliced(batches):
            texts = batch.column(place).to_pylist()
            base = [base_spans(t or "") for t in texts]
            more = model.added([t or "" for t in texts], base)
            texts = [t if t is None else redacted(t, b + m) for t, b, m in zip(texts, base, more)]
            columns = batch.columns
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            if chars is not None:
                own = batch.column(chars).to_pylist()
                columns[chars] = pa.array([n if t is None else len(t) for t, n in zip(texts, own)], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return small_batches(docs).mapInArrow(redact, docs.schema)
