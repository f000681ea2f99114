from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from panelwright.llm import lm, mixing, queries
from panelwright.llm.common import held_out
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def base_scores(rows):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in rows}


def trained(words, times):
    code = mixing.Code.of_words(words, times)
    counts = mixing.Counts(code)
    counts.add(words, times)
    less = [np.stack([mixing.packed(np.maximum(n[0] - 1, 0), n[1]), mixing.packed(n[0], np.maximum(n[1] - 1, 0))]) for n in counts.n]
    learner = mixing.Mixer(code, less)
    seen = learner.learn(words, times)
    return counts, mixing.Mixer(code, [mixing.packed(*n) for n in counts.n], learner.weights, mixing.refinement(seen))


def test_word_probabilities_sum_to_less_than_one_and_words_of_one_byte_to_their_share():
    words = [b"ab", b"abc", b"b", b"", "é".encode()]
    _, mixer = trained(words, np.array([40.0, 20, 10, 30, 5]))
    short = [bytes(p) for n in range(3) for p in product(range(256), repeat=n) if 32 not in p]
    total = (10.0 ** mixer.log10(short)[0]).sum()
    rest = 1 - total  # longer words, and bytes that no word holds
    assert 0 < rest < 1 and total > 0.5
    assert (cost := mixer.log10([b"ab", b"ac", b"zz"])[0])[0] > cost[1] > cost[2]


def test_decisions_follow_a_prefix_code():
    code = mixing.Code(np.arange(256) ** 2)
    paths = {tuple(zip(code.nodes[b, : code.sizes[b]], code.bits[b, : code.sizes[b]])): b for b in range(256)}
    spelled = {"".join(str(bit) for _, bit in p) for p in paths}
    assert len(spelled) == 256 and not any(a != b and b.startswith(a) for a in spelled for b in spelled) and sum(2.0 ** -len(p) for p in spelled) == 1
    d = mixing.Decisions([b"a", b"", b"zz"], code)
    read = [paths[tuple(zip(d.node[own], d.bit[own]))] for w in range(3) for p in range(3) for own in [(d.word == w) & (d.place == p)] if own.any()]
    assert bytes(read) == b"a  zz "
    same = mixing.Decisions([b"x", b"zz"], code)
    assert all((a[d.word == 2] == b[same.word == 1]).all() for a, b in zip(d.slots, same.slots))  # wherever the word stands


def test_passes_do_not_change_results(monkeypatch):
    rng = random.Random(1)
    words = sorted({bytes(rng.randrange(33, 127) for _ in range(rng.randrange(9))) for _ in range(300)}) + [b"q" * 5000]
    _, mixer = trained(words, np.ones(len(words)))
    whole, starts = mixer.log10(words)
    together: dict[bytes, set] = {}
    for w, cost, start in zip(words, whole, starts):
        together.setdefault((w + b" ")[:2], set()).add(round(start, 6))
        assert start >= cost - 1e-9 and (len(w) > 1 or abs(start - cost) < 1e-9)
    assert all(len(x) == 1 for x in together.values())
    monkeypatch.setattr(mixing, "PASS", 300)
    again = mixer.log10(words)
    assert np.allclose(again[0], whole) and np.allclose(again[1], starts)


def test_adapted_is_a_mixture_of_proper_adaptive_estimates():
    rng = random.Random(3)
    spelling = {"aab": 0.3, "aac": 0.2, "b ": 0.35, "cx": 0.15}
    start_p = {"aa": 0.5, "b ": 0.35, "cx": 0.15}
    seq = [rng.choice(list(spelling)) for _ in range(60)]
    totals = []
    for r in lm.RATES:
        seen, begun, new, total = Counter(), Counter(), 0, 0.0
        for t, w in enumerate(seq):
            p = {x: (seen[x] + r * (begun[x[:2]] + lm.START_RATE * start_p[x[:2]]) / (new + lm.START_RATE) * spelling[x] / start_p[x[:2]]) / (t + r) for x in spelling}
            assert sum(p.values()) == pytest.approx(1)
            total += math.log10(p[w])
            if not seen[w]:
                begun[w[:2]] += 1
                new += 1
            seen[w] += 1
        totals.append(total)
    ids = np.array([list(spelling).index(w) for w in seq])
    starts = np.array([list(start_p).index(w[:2]) for w in seq])
    twice = lambda x: np.concatenate([x, x])  # noqa: E731  (two documents do not see each other)
    got = lm.adapted(twice(ids), twice(starts), twice(np.array([spelling[w] for w in seq])), twice(np.array([start_p[w[:2]] for w in seq])), np.array([60, 60]))
    assert got.tolist() == pytest.approx([math.log10(sum(10**t for t in totals) / len(totals))] * 2)


@pytest.mark.parametrize("top", [300_000, 50])
def test_base_scores_against_brute_force(spark, monkeypatch, top):
    monkeypatch.setattr(lm, "TOP", top)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = base_scores(rows)
    got = queries.op9_lm(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score < 0


def test_held_out_texts_cost_less_than_with_the_base(spark):
    got = [r for r in queries.op9_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(got) > 60 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "Word word"), (3, "x" * 100_000), (4, "w " * 100_000), (5, "\u0000 é\x0b")]
    docs = spark.createDataFrame([(i, t, "score", 1) for i, t in rows], "doc_id long, text string, word string, n_tokens int").repartition(3)
    model, words = lm.fit(docs.select("text"))
    got = lm.score(docs, model, words, [F.col("doc_id")], F.col("text")).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, len(tokens(t))) for i, t in rows)
    assert all(r.n_known == r.n_tokens and np.isfinite(r.score) for r in got)
    assert lm.score(docs.limit(0), model, words, [F.col("doc_id")], F.col("text")).count() == 0
    nothing, none = lm.fit(docs.limit(0).select("text"))
    got = lm.score(docs, nothing, none, [F.col("doc_id")], F.col("text")).collect()
    assert len(got) == 7 and all(r.n_known == 0 and np.isfinite(r.base_score + r.score) and r.train_tokens == 0 for r in got)


def test_every_byte_of_a_long_word_counts():
    rng = random.Random(7)
    _, mixer = trained([b"ab", b"abc", b"b", b""], np.array([40.0, 20, 10, 30]))
    long = bytes(rng.randrange(33, 127) for _ in range(3000))
    words = [long[:200], long[:1000], long, b""]
    facts, starts = lm._facts(mixer, words)
    whole = mixer.log10(words)[0]
    ids = np.array([0, 3, 1, 3, 2, 3, 2, 2, 3])
    got = lm.adapted_logs(ids, starts[ids], facts[ids, 0], facts[ids, 1], np.array([2, 2, 2, 3]))
    assert whole[2] < whole[1] < -300
    assert got[1] - got[0] == pytest.approx(whole[1] - whole[0]) and got[2] - got[1] == pytest.approx(whole[2] - whole[1])
    # The second time the word is known, and costs no more than its place in the count.
    assert got[3] == pytest.approx(got[2], abs=5)


def plain_scores(rows, model):
    """log10 of each text by the printed rules, one document after the other: (id, text, learned) to (id, score)."""
    spelled, parts = {}, {}
    for i, text, _ in rows:
        ws = lm.words_of(None if text is None else text.encode()) + [b""]
        for w in ws:
            if w not in spelled:
                facts, starts = lm._facts(model.mixer, [w])
                spelled[w] = (facts[0, 0], facts[0, 1], int(starts[0]))
        seen, begun, new = Counter(), Counter(), 0
        logs, to_here = [0.0] * len(lm.RATES), []
        for t, w in enumerate(ws):
            whole, start, key = spelled[w]
            s = math.log10((begun[key] + lm.START_RATE * 10**start) / (new + lm.START_RATE)) + whole - start
            logs = [x + (math.log10((seen[w] + r * 10**s) / (t + r)) if seen[w] else math.log10(r / (t + r)) + s) for x, r in zip(logs, lm.RATES)]
            best = max(logs)
            to_here.append(best + math.log10(sum(10 ** (x - best) for x in logs) / len(logs)))
            if not seen[w]:
                begun[key] += 1
                new += 1
            seen[w] += 1
        _, ends, whole, before = lm.stretches(lm.hashes_of(ws), np.array([len(ws)]))
        parts[i] = (to_here[-1], [(int(c), int(x), to_here[e] - to_here[e0]) for c, x, e, e0 in zip(before, whole, ends, [0, *ends]) if c])
    table = {}
    for i, _, learned in rows:
        if learned:
            for c, x in {(c, x) for c, x, _ in parts[i][1]}:
                table.setdefault(c, Counter())[x] += 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    told = {}
    for i, _, learned in rows:
        told[i] = []
        for c, x, log in parts[i][1]:
            if c in table:
                best, n = max(table[c].items(), key=lambda p: (p[1], signed(p[0])))
                n, others = n - (learned and x == best), sum(table[c].values()) - learned
                if n > 0:
                    told[i].append((min(n, lm.SUPPORTS) - 1, min(lm.SHARES * n // others, lm.SHARES - 1), x == best, log))
    hits, all_ = Counter(), Counter()
    for i, _, learned in rows:
        for a, b, hit, _ in told[i] if learned else ():
            hits[a, b] += hit
            all_[a, b] += 1
    out = {}
    for i, _, _ in rows:
        k = n = 0
        score = parts[i][0]
        for a, b, hit, log in told[i]:
            prior = (hits[a, b] + lm.MAP_PRIOR * (b + 0.5) / lm.SHARES) / (all_[a, b] + lm.MAP_PRIOR) if all_[a, b] else (b + 0.5) / lm.SHARES
            p = min(max((k + lm.MAP_RATE * prior) / (n + lm.MAP_RATE), 1e-4), 1 - 1e-4)
            score += math.log10(p + (1 - p) * 10**log) - log if hit else math.log10(1 - p)
            k, n = k + hit, n + 1
        out[i] = score
    return out


def test_scores_against_the_rules_in_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 != 0) for r in docs.collect()]
    learned = ~held_out("doc_id", 10, 0)
    model, words = lm.fit(docs.where(learned).select("text"))
    want = plain_scores(rows, model)
    got = {r.doc_id: r for r in lm.score(docs, model, words, [F.col("doc_id")], F.col("text"), learned).collect()}
    assert {i: r.score for i, r in got.items()} == pytest.approx(want, rel=1e-6)
    sizes = {i: len((t or "").encode()) for i, t, _ in rows}
    assert all(r.bits_per_byte == (pytest.approx(-r.score * math.log2(10) / sizes[i]) if sizes[i] else None) for i, r in got.items())


def test_stretches_cut_alike_wherever_a_passage_stands():
    rng = random.Random(4)
    passage = [b"w%d" % rng.randrange(400) for _ in range(300)]
    docs = [passage, [b"a", b"b", b"c", b"d", *passage, b"z"], [b"q", b"r"], [b""], [b"x"] * 50]
    sizes = np.array([len(d) for d in docs])
    owner, ends, whole, before = lm.stretches(np.concatenate([lm.hashes_of(d) for d in docs]), sizes)
    assert [int(e) for e in ends if e + 1 in np.cumsum(sizes)] == (np.cumsum(sizes) - 1).tolist()
    of = [set(zip(before[owner == k].tolist(), whole[owner == k].tolist())) - {(0, w) for w in whole.tolist()} for k in range(5)]
    assert len(of[0]) > 8 and len(of[0] & of[1]) >= len(of[0]) - 3 and not of[0] & of[4]
    assert (before[owner == 2] == 0).all() and (before[owner == 3] == 0).all()
    alone = lm.stretches(lm.hashes_of(docs[1]), sizes[1:2])
    assert (alone[2] == whole[owner == 1]).all() and (alone[3] == before[owner == 1]).all()


def test_a_passage_of_the_training_texts_scores_apart(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(200)
    train = [say(200) for _ in range(60)] + [passage]
    other = say(200)
    shuffled = passage.split()
    rng.shuffle(shuffled)
    test = [passage, " ".join(shuffled), say(20) + " " + passage[: len(passage) // 2], other]
    docs = spark.createDataFrame([(k, t, k < len(train)) for k, t in enumerate(train + test)], "doc_id long, text string, learned boolean")
    model, counts = lm.fit(docs.where("learned").select("text"))
    got = {r.doc_id: r.bits_per_byte for r in lm.score(docs, model, counts, [F.col("doc_id")], F.col("text"), F.col("learned")).collect()}
    n = len(train)
    assert got[n] < 0.5 * got[n + 1] and got[n + 2] < 0.8 * got[n + 3] and got[n - 1] > 0.9 * got[0]  # a training text is not told by itself
