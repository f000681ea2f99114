from __future__ import annotations

import random

import pytest
from panelwright.llm import decontaminate as dc
from panelwright.llm import queries
from pyspark.sql import functions as F

RNG = random.Random(12)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def smith_waterman(item, text):
    best, table = 0, [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            alike = len(a) >= 4 and len(b) >= 4 and a[:4] == b[:4]
            step = dc.EQUAL if a == b else dc.ALIKE if alike else dc.UNEQUAL
            table[i][j] = max(0, table[i - 1][j - 1] + step, table[i - 1][j] - dc.GAP, table[i][j - 1] - dc.GAP)
            best = max(best, table[i][j])
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = random.Random(1)
    for _ in range(60):
        item = passage(rng, rng.randint(5, 20))
        text = [w for w in item if rng.random() < 0.8] + passage(rng, rng.randint(1, 30))
        items = dc.Items([(1, " ".join(item))])
        assert items.align(0, text)[1] == smith_waterman(item, text)


def edited(rng, words, share):
    out = []
    for w in words:
        r = rng.random()
        out += [] if r < share / 3 else [w, rng.choice(WORDS)] if r < 2 * share / 3 else [rng.choice(WORDS)] if r < share else [w]
    return out


@pytest.mark.parametrize("blocks", [20_000, 7])
def test_copies_are_found_and_clean_rows_left_alone(spark, monkeypatch, blocks):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", blocks)
    rng = random.Random(2)
    bench = [(k, " ".join(passage(rng, rng.randint(12, 40)))) for k in range(30)] + [(50, "the of"), (51, None), (None, "a b c d e f g")]
    docs, truth = [], {}
    for i in range(300):
        words = passage(rng, rng.randint(0, 120))
        if i % 3 == 0:
            item = rng.randrange(30)
            copy = bench[item][1].split()
            copy = copy if i % 2 else edited(rng, copy, 0.1)
            words[len(words) // 2 : len(words) // 2] = copy
            truth[i] = item
        docs.append((i, " ".join(words).upper(), "item_id", 1.0))
    docs += [(1000, None, "x", 0.0), (1001, "", "x", 0.0), (1002, "x " * 200_000, "x", 0.0), (1003, bench[0][1], "x", 0.0), (1003, bench[0][1], "x", 0.0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, coverage double").repartition(4)
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = dc.contamination(d, b, [F.col("doc_id")], F.col("text")).collect()
    assert len(rows) == len(docs)
    reached = 0
    for r in rows:
        if r.doc_id < 1000 and r.doc_id in truth:
            whole = dc.Items([(0, bench[truth[r.doc_id]][1])]).align(0, dc.words_of(docs[r.doc_id][1]))[0]
            assert r.contaminated == (whole >= dc.COVERAGE) and r.item_id == truth[r.doc_id] and r.coverage == pytest.approx(whole)
            reached += r.contaminated
        else:
            assert r.contaminated == (r.doc_id == 1003)
    assert reached > 80
    assert dc.contamination(d.limit(0), b, [F.col("doc_id")], F.col("text")).count() == 0
    assert not any(r.contaminated for r in dc.contamination(d.limit(20), b.limit(0), [F.col("doc_id")], F.col("text")).collect())


def test_an_item_in_very_many_documents_keeps_its_seeds(spark):
    rng = random.Random(3)
    leak = " ".join(passage(rng, 25))
    docs = spark.createDataFrame([(i, " ".join(passage(rng, 20)) + (" " + leak if i % 2 else "")) for i in range(200)], "doc_id long, text string")
    rows = dc.contamination(docs, spark.createDataFrame([(1, leak)], "item_id long, text string"), [F.col("doc_id")], F.col("text")).collect()
    assert all(r.contaminated == bool(r.doc_id % 2) for r in rows)


def test_whole_table_against_brute_force(spark):
    """Each document against each item by plain search of whole passages and by full alignment."""
    sf = "/root/testdata/sf0.001"
    bench = [(r.item_id, dc.words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items = dc.Items([(i, " ".join(w)) for i, w in bench])
    got = {r.doc_id: r for r in queries.op7_decontamination(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = dc.words_of(r.text or "")
        whole = " " + " ".join(words) + " "
        verbatim = any(f" {' '.join(w)} " in whole for _, w in bench)
        best = max((items.align(k, words)[0] for k in range(len(bench))), default=0) if words and len(words) < 600 else None
        assert got[r.doc_id].contaminated or not verbatim
        if best is not None:
            assert got[r.doc_id].contaminated == (best >= dc.COVERAGE)


def test_long_windows_are_cut_without_losing_the_best_place():
    rng = random.Random(8)
    item = passage(rng, 15)
    text = []
    for _ in range(600):
        text += [w for w in item if rng.random() < 0.7] + passage(rng, rng.randrange(4))
    text[4000:4000] = item
    items = dc.Items([(1, " ".join(item))])
    found = items.matches(text)
    assert found[0][0] == 1.0 == items.align(0, text)[0] and text[found[0][3] : found[0][4]] == item
    pieces = dc._cut([(0, len(text))], 15)
    assert len(pieces) > 20 and pieces[-1][1] == len(text) and all(a[1] - b[0] >= 45 for a, b in zip(pieces, pieces[1:]))


def test_repetitive_items_and_copies_with_many_insertions_are_found():
    rng = random.Random(5)
    refrain = "a b c ".split() * 20
    items = dc.Items([(1, " ".join(refrain))])
    assert items.matches(passage(rng, 30) + refrain + passage(rng, 30))[0][0] == 1.0
    item = [f"w{k}" for k in range(60)]
    copy = [f"y{k}" if k % 5 == 2 else w for k, w in enumerate(item)]
    for at in range(56, 0, -7):
        copy.insert(at, f"z{at}")
    items = dc.Items([(1, " ".join(item))])
    assert items.align(0, copy)[0] >= dc.COVERAGE and items.matches(copy)[0][0] == items.align(0, copy)[0]


def test_left_out_places_change_no_result():
    rng = random.Random(6)
    few = WORDS[:12]
    items = dc.Items([(k, " ".join(rng.choice(few) for _ in range(rng.randint(5, 30)))) for k in range(25)])
    for _ in range(40):
        text = [rng.choice(few) for _ in range(rng.randint(5, 80))] + edited(rng, items.words[rng.randrange(25)], 0.3)
        got = items.matches(text)
        for k in range(25):
            assert items.bound(k, text) >= items.align(k, text)[0]
        every = []
        with pytest.MonkeyPatch.context() as m:
            m.setattr(dc.Items, "bound", lambda *_: 1.0)
            every = items.matches(text)
        best = lambda found: max(((f[0], f[2], -f[1]) for f in found), default=None)
        assert best(got) == best(every) and {f[1] for f in got if f[0] >= dc.COVERAGE} == {f[1] for f in every if f[0] >= dc.COVERAGE}


def lossy(rng, words, kind, share):
    """A copy in which that share of the words is replaced, left out, or has a word put in before it."""
    at = set(rng.sample(range(len(words)), int(share * len(words) + 1e-9)))
    new = lambda: "q" + rng.choice(WORDS)
    return [x for k, w in enumerate(words) for x in ([w] if k not in at else [new()] if kind == "replaced" else [] if kind == "left out" else [new(), w])]


@pytest.mark.parametrize("kind", ["replaced", "left out", "put in"])
def test_recall_of_edited_copies_in_texts_of_any_length(kind):
    """Against full alignment, with the seeds that the frequencies of a corpus leave."""
    rng = random.Random(13)
    bench = [(k, " ".join(passage(rng, rng.choice([5, 6, 7, 10, 15, 25, 60])))) for k in range(70)]
    items = dc.Items(bench)
    frequency = {}
    for _ in range(60):  # other documents hold parts of the items
        for c in set(items.hits([w for _ in range(3) for w in (lambda x, s: x[s : s + 8])(items.words[rng.randrange(70)], rng.randrange(10))])[1].tolist()):
            frequency[int(items.codes[c])] = frequency.get(int(items.codes[c]), 0) + 1
    items.choose_seeds(frequency)
    assert not all(all(s) for s in items.seed)
    wanted = reached = 0
    for turn in range(350):
        k = turn % 70
        copy = lossy(rng, items.words[k], kind, rng.uniform(0.1, 0.2) if kind != "put in" else rng.uniform(0.1, 0.3))
        around = rng.choice([0, 30, 2000])
        text = passage(rng, around) + copy + passage(rng, around)
        if items.align(k, copy)[0] >= dc.COVERAGE:
            wanted += 1
            reached += any(f[1] == k and f[0] >= dc.COVERAGE for f in items.matches(text))
    assert wanted > 200
    assert reached == wanted if kind != "put in" else reached >= 0.97 * wanted


def test_every_way_to_lose_words_leaves_a_seed():
    from itertools import combinations

    for m in range(dc.MIN_WORDS, 16):
        items = dc.Items([(1, " ".join(f"w{k}" for k in range(m)))])
        items.choose_seeds({int(c): n % 3 for n, c in enumerate(items.codes)})
        size, lost = items.gram(0), dc._lost(m)
        seeds = [at for places, keep in zip(items.places, items.seed) for (_, at), s in zip(places, keep) if s]
        for gone in combinations(range(m), lost):
            assert any(not set(range(at, at + size)) & set(gone) for at in seeds)


def test_long_items_take_memory_in_proportion():
    import tracemalloc

    rng = random.Random(14)
    item = passage(rng, 6000)
    text = passage(rng, 3000) + edited(rng, item, 0.1) + passage(rng, 3000)
    items = dc.Items([(1, " ".join(item))])
    tracemalloc.start()
    coverage = items.align(0, text)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert coverage > 0.85 and peak < 40e6


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    rng = random.Random(15)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 2000)
    bench = spark.createDataFrame([(k, " ".join(passage(rng, 30))) for k in range(40)], "item_id long, text string")
    blocks = list(dc._blocks(bench, "item_id", "text"))
    assert len(blocks) > 2 and sorted(i for b in blocks for i in b.ids) == list(range(40))
