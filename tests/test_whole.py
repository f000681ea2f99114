"""Queries over small tables of their own, with rows that a cut of the input would lose."""

from __future__ import annotations

from collections import Counter

import pytest
from panelwright.functions import quotes
from panelwright.operators import diff, evidence
from panelwright.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables: tables(name=(rows, schema), ...)."""

    def make(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(*texts):
    """Rows of documents; the last has no n_chars."""
    rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    return [*rows[:-1], (*rows[-1][:4], None)], DOCUMENTS


def test_word_presence_reads_documents_of_any_length(spark, tables):
    texts = ["a b", "filler " * 600 + "a b c", "long " * 4000 + "a b c d", None, "a b c d e"]
    items = [(1, "a b c d e f"), (2, "A b  c d e"), (3, "long filler"), (4, None)]
    rows, schema = documents(*texts)
    rows = [(*r[:2], "de" if r[0] == 2 else "en", *r[3:]) for r in rows]
    sf = tables(documents=(rows, schema), benchmark=(items, "item_id long, text string"))
    want = {}
    for item, passage in items:
        words = set((passage or "").lower().split())
        for _, text, lang, *_ in rows:
            held = len(words & set((text or "").lower().split()))
            if held:
                want[item, lang] = max(want.get((item, lang), 0), round(held / len(words), 4))
    got = {(r.item_id, r.lang): r.presence for r in registry.QUERIES["word_presence"](spark, sf).collect()}
    assert got == want and got[1, "de"] == 0.6667 and got[2, "en"] == 1.0


def test_halved_parts_halves_documents_of_any_length(spark, tables):
    sf = tables(documents=documents("x" * 700, "y" * 1000, "z" * 12_000, None, "w" * 1600))
    got = {r.key: (r.pieces, r.n_failed, r.sent) for r in registry.QUERIES["halved_parts"](spark, sf).collect()}
    assert got == {0: (1, 0, 700), 1: (2, 0, 1000), 2: (8, 8, None), 3: (1, 0, 0), 4: (2, 0, 1600)}


def test_quote_match_gives_a_result_for_every_document(spark, tables):
    words = " ".join(f"w{k}" for k in range(3000))
    sf = tables(documents=documents("too short", words, words, "w " * 40 + "tail", None, words[:400]))
    got = {r.doc_id: (r.score, r.word_share, r.decided_by) for r in registry.QUERIES["quote_match"](spark, sf).collect()}
    want = {k: quotes.matched(q, t) for k, q, t in ((1, words[49:109], words), (2, words[49:109] + " zzz qqq www vvv uuu ttt sss rrr", words), (3, ("w " * 40 + "tail")[49:], "w " * 40 + "tail"), (5, words[49:109], words[:400]))}
    assert got == {0: (0.0, None, None), 4: (0.0, None, None), **want}
    assert got[1][2] is not None and got[2][2] is None


def test_provenance_origins_walks_every_record_to_its_end(spark, tables):
    sf = tables(part=([(k,) for k in range(1, 20_001)], "p_partkey long"))
    source = {k: k + 1 if k % 50 == 0 else k // 3 for k in range(1, 20_001)}
    got = {r.record: (r.origin, r.cyclic) for r in registry.QUERIES["provenance_origins"](spark, sf).collect()}
    assert len(got) == 20_000 and source[20_000] == 20_001
    for k in source:
        at = k
        while at in source:
            at = source[at]
        assert got[k] == (at, False)


def test_origins_of_deep_chains_and_chains_into_cycles(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (102, 103), (103, 101), (200, 200), (300, None), (400, 401), (400, 402)]
    got = sorted(map(tuple, evidence.origins(spark.createDataFrame(edges, "record long, source long")).collect()), key=str)
    want = [(k, 60, False) for k in range(60)] + [(100, 101, True), (101, 101, True), (102, 102, True), (103, 103, True), (200, 200, True), (300, None, False), (400, 401, False), (400, 402, False)]
    assert got == sorted(want, key=str)


def test_clique_groups_holds_every_document(spark, tables):
    sf = tables(documents=documents(*["t"] * 752))
    got = {r.node: r.root for r in registry.QUERIES["clique_groups"](spark, sf).collect()}
    # The last clique, 750 to 752, lacks its third node and stays one of two.
    assert got == {k: k - k % 30 if k % 30 <= 2 else k for k in range(752)}


def test_spans_of_every_event_meet(spark, tables):
    kinds = ["view", "error", "click", "purchase", "signup"]
    rows = [(k, k // 5, kinds[k % 5], f'{{"k": {k % 29}}}') for k in [*range(100), *range(4000, 4300), *range(90_000, 90_200)]]
    sf = tables(events=(rows, "event_id long, user_id long, event_type string, props string"))
    spans = [(user % 20, k, k * 7 % 5000, k * 7 % 5000 + k % 29 % 30, kind) for k, user, kind, _ in rows]
    a, b = [s for s in spans if s[4] in ("view", "click")], [s for s in spans if s[4] in ("error", "purchase")]
    met = {(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < x[3] and max(x[2], y[2]) < min(x[3], y[3])}
    assert {tuple(r) for r in registry.QUERIES["span_overlap"](spark, sf).select("page", "a_id", "b_id").collect()} == met
    assert any(x >= 4000 for _, x, _ in met)
    assert {r.id for r in registry.QUERIES["span_anti"](spark, sf).collect()} == {x[1] for x in a} - {x for _, x, _ in met}


def test_follow_links_reads_every_link(spark, tables):
    sf = tables(part=([(1_031,), (1_043,)], "p_partkey long"), nation=([(k,) for k in range(25)], "n_nationkey long"))
    got = {(r.institution, r.url, r.hop) for r in registry.QUERIES["follow_links"](spark, sf).collect()}
    starts = {k: k * 31 % 200 for k in range(25)}
    links = {p % 200: p * 7 % 211 for p in (1_031, 1_043)}
    assert got == {(k, u, 0) for k, u in starts.items()} | {(k, links[u], 1) for k, u in starts.items() if u in links} | {(k, links[links[u]], 2) for k, u in starts.items() if u in links and links[u] in links}
    assert {(1, 43, 1), (1, 127, 2)} <= got


def test_year_candidates_reads_whole_texts(spark, tables):
    texts = ["x" * 50 + " in 2016, 2031 and 12017; 2016", None, "2018 " + "word " * 5000 + "2019"]
    sf = tables(documents=documents(*texts))
    want = Counter([2016, 2016, 2018, 2019])
    for k in range(len(texts)):
        want.update(y for y in (2010 + k % 25, 2020) if 2015 <= y <= 2030)
    assert {r.year: r.n for r in registry.QUERIES["year_candidates"](spark, sf).collect()} == want


def test_most_diverged_stage_is_no_row_where_no_stage_diverged(spark, tables):
    kinds = ["click", "view", "error", "signup", "purchase"]
    rows = [(k, k // 5 % 2, kinds[k % 5], 1.0, f'{{"k": {k // 10}}}') for k in range(30)]
    schema = "event_id long, user_id long, event_type string, value double, props string"
    sf = tables(events=(rows, schema))
    assert registry.QUERIES["run_deltas"](spark, sf).count() == 0
    assert registry.QUERIES["most_diverged_stage"](spark, sf).collect() == []


def test_most_diverged_takes_the_first_stage_on_ties(spark):
    stages = [("c", 2, 5), ("a", 3, 5), ("b", 1, 4), ("d", None, 5)]
    schema = "stage string, position int, n_diverged long"
    assert list(map(tuple, diff.most_diverged(spark.createDataFrame(stages, schema)).collect())) == [("c", 5)]
    assert diff.most_diverged(spark.createDataFrame([(s, p, 0) for s, p, _ in stages], schema)).collect() == []
