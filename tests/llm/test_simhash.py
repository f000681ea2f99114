from __future__ import annotations

import random
import re
from itertools import combinations

import pytest
import xxhash
from panelwright.llm import queries, simhash
from panelwright.operators.components import components
from pyspark.sql import functions as F


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints: dict[int, int]) -> dict[int, int]:
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: root(i) for i in prints}


def test_fingerprint_of_whole_texts():
    rng = random.Random(1)
    for _ in range(300):
        text = rng.choice([" ", "\n", "\t \x0b"]).join(rng.choice(["Ab", "é", "C", "d,", " ", "\x1f"]) for _ in range(rng.randrange(12)))
        assert simhash.fingerprint(text.encode()) % (1 << 64) == plain(text)
    long = " ".join(str(rng.randrange(999)) for _ in range(140_000))
    assert simhash.fingerprint(long.encode()) % (1 << 64) == plain(long)


def test_every_link_has_a_key():
    rng = random.Random(2)
    masks = [(s, simhash._mask(s, (0, 1, *p)) % (1 << 64)) for s in range(10) for p in simhash.PAIRS]
    for _ in range(20_000):
        differ = 0
        for b in rng.sample(range(64), rng.randrange(5)):
            differ |= 1 << b
        assert any(differ & m == 0 and all((differ & simhash._mask(s, range(n)) % (1 << 64)).bit_count() <= most for n, most in simhash.BUDGETS) for s, m in masks)


@pytest.mark.parametrize("least", [32, 1])
def test_components_on_made_fingerprints(spark, monkeypatch, least):
    """Chains, dense groups and lone fingerprints against brute force, with few and with many keys taken for hot."""
    monkeypatch.setattr(simhash, "HOT_LEAST", least)
    rng = random.Random(4)
    prints, at = {}, 0
    for size, step in ((60, 3), (40, 4), (200, 1), (30, 0)):
        fp = rng.getrandbits(64)
        for _ in range(size):
            prints[at] = fp
            at += 1
            for b in rng.sample(range(64), step):
                fp ^= 1 << b
    centre = rng.getrandbits(64)
    for _ in range(250):
        prints[at] = centre ^ sum(1 << b for b in rng.sample(range(64), 3))
        at += 1
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in prints.items()]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r.fp: r.root for r in simhash.linked(df.select("fp").distinct()).collect()}
    want = brute(prints)
    for (i, f), (j, g) in combinations(signed, 2):
        assert (got.get(f, f) == got.get(g, g)) == (want[i] == want[j])


def test_near_duplicates(spark):
    rng = random.Random(6)
    vocabulary = ["w%d" % i for i in range(300)]
    rows = []
    for k in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((len(rows), " ".join(copy), "fp", k))
    rows += [(900, None, "x", 0), (901, "", "x", 0), (902, " \n", "x", 0), (903, "one two", "x", 0), (903, "one two", "x", 0), (None, "one two", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, slot int").repartition(5)
    got = simhash.near_duplicates(docs).collect()
    prints = {k: plain(r[1]) for k, r in enumerate(rows)}
    assert sorted(r.fp % (1 << 64) for r in got) == sorted(prints.values())
    want = {rows[k][0]: rows[v][0] for k, v in brute(prints).items() if rows[k][0] is not None}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [903]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_keeper_per_component(spark):
    rows = [(1, "a b c d e", "q"), (1, "a b c d e", "p"), (None, "a b c d e", "p"), (2, "z", "p"), (2, "a b c d e", "p"), (3, "y x", "p"), (1, "other words", "p"), (4, None, None), (None, "only here", None), (5, "Z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0) for r in got if r.keeper) == [0, 1, 1, 1, 2, 3, 4] and len(got) == len(rows)
    one = sorted((r.doc_id or 0, r.text or "", r.fp or "") for r in simhash.one_of_each(docs).collect())
    assert one == [(0, "only here", ""), (1, "a b c d e", "p"), (1, "other words", "p"), (2, "z", "p"), (3, "y x", "p"), (4, "", "")]
    assert simhash.one_of_each(docs.limit(0)).count() == 0 and simhash.one_of_each(docs).columns == docs.columns


def test_graph_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 400)] + [(500, 500), (None, 3), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 400)}, 500: 500}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = brute({r.doc_id: plain(r.text) for r in rows})
    got = queries.op3_simhash(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == {r.doc_id: plain(r.text) for r in rows}
