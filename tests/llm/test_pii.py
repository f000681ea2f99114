from __future__ import annotations

import hashlib
import random
import re

from panelwright.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text: str):
    digits = lambda t: re.sub("[^0-9]", "", t)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(6000):
        text = "".join(rng.choice(["a", "b.", "@", "1", "22", "255", "300", ".", "-", " ", "+", "(", ")", "é", "4111111111111111", "x@y.z", "+1 (208) 555-3235", "1.2.3.4"]) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 200_000, "+1(" * 90_000, "a@" * 90_000, "a-" * 100_000, "ab:" * 80_000, " at dot" * 30_000, "[at" * 60_000):
        spans = pii.base_spans(text)
        pii.trained().added([text], [spans])
    assert pii.base_spans("0" * 9000 + "1.2.3.4") == [("ip", 0, 9007)]


def test_added_spans_on_unseen_sentences():
    fresh = pii.training_set(1500, seed=77)
    texts = [t for t, _ in fresh]
    found = pii.trained().added(texts, [pii.base_spans(t) for t in texts])
    right = wrong = missed = 0
    for (text, want), got in zip(fresh, found):
        base = [(s, e) for _, s, e in pii.base_spans(text)]
        want = [w for w in want if not any(s < w[2] and w[1] < e for s, e in base)]
        right += sum(g in want for g in got)
        wrong += sum(g not in want for g in got)
        missed += sum(w not in got for w in want)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.9


def test_query_rows(spark):
    texts = ["mail a.b@c.de or 1.2.3.4", None, "", "card 4111 1111 1111 1111, +1 (208) 555-3235", "card 4111 1111 1111 1111, +1 (208) 555-3235", "x" * 200_000 + " a@b.c"]
    docs = spark.createDataFrame([(i, t, "spans") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pii.find_pii(docs, with_redacted=True).collect()}
    for i, t in enumerate(texts):
        want = brute(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(w[0] == k for w in want) for k in pii.BASE_KINDS]
    assert rows[0].redacted == "mail [EMAIL] or [IP]" and rows[1].redacted == ""
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_whole_table(spark):
    out = queries.op1_pii(spark, "/root/testdata/sf0.001").collect()
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        mine = next(r for r in out if r.doc_id == row.doc_id)
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(row.text or ""))
        assert mine.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(mine.spans.split(","))


def test_a_long_local_part_is_read_back_to_its_beginning():
    text = "write to " + "q" * 90 + " at example dot org or " + "w" * 300 + "[at]b.example.com now"
    spans = [c for c in pii.candidates(text) if c[0] == "email"]
    assert [text[s:e] for _, s, e in spans] == ["q" * 90 + " at example dot org", "w" * 300 + "[at]b.example.com"]
    _, s, e = spans[0]
    assert pii.features(text, "email", s, e)[len(pii.KINDS)] == 80 and pii.features("a1" * 4000, "secret", 0, 8000)[len(pii.KINDS) + 1] == 4000


def test_spans_tell_what_touches():
    rng = random.Random(8)
    for _ in range(300):
        spans, marked = pii.Spans(), set()
        for _ in range(rng.randrange(12)):
            start = rng.randrange(60)
            end = start + rng.randrange(1, 9)
            assert spans.touches(start, end) == bool(marked & set(range(start, end)))
            spans.add(start, end)
            marked |= set(range(start, end))


def test_many_candidates_take_about_linear_time():
    text = "call 212-555-0188 or 10.0.0.1, " * 20_000
    base = pii.base_spans(text)
    found = pii.trained().added([text], [base])[0]
    assert len(base) == 20_000 and len(found) >= 19_000
