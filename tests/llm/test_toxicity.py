from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from panelwright.llm import queries, toxicity
from panelwright.llm.common import held_out
from panelwright.llm.toxicity import AIMED, END, INSULT, INTENT, NEGATED, NEGATION, OTHER, QUOTE, REPORT, REPORTED, TARGET, THREAT
from pyspark.sql import functions as F

VOCABULARY = ["the", "house", "green", "river", "walks", "slowly", "and", "tree", "of", "stone", "light", "paper"]


def made(n: int, seed: int):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(4, 80))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["grubber", "zorq" + rng.choice(["ing", "ed", "xy"])])
        docs.append((i, " ".join(words), i % 3, "label_"))
        labels.append((i, int(toxic)))
    return docs, labels


def run(symbols):
    state, out = toxicity.GRAMMAR.start, []
    for s in symbols:
        state, kind, _ = toxicity.GRAMMAR.step(state, s)
        out.append(kind)
    return out


def weights(symbols):
    state, out = toxicity.GRAMMAR.start, []
    for s in symbols:
        state, _, weight = toxicity.GRAMMAR.step(state, s)
        out.append(weight)
    return out


def test_composed_grammar():
    assert run([OTHER, INSULT])[-1] == INSULT
    assert run([NEGATION, OTHER, INSULT])[-1] == NEGATED
    assert run([NEGATION, OTHER, OTHER, OTHER, INSULT])[-1] == INSULT
    assert run([NEGATION, END, INSULT])[-1] == INSULT
    assert run([REPORT, OTHER, QUOTE, OTHER, INSULT])[-1] == REPORTED
    assert run([REPORT, QUOTE, OTHER, QUOTE, INSULT])[-1] == INSULT
    assert run([TARGET, OTHER, INSULT])[-1] == AIMED
    assert run([TARGET, END, INSULT])[-1] == INSULT
    assert weights([THREAT]) == [0.0] and weights([INTENT, OTHER, THREAT])[-1] == 0.5 and weights([INTENT, END, THREAT])[-1] == 0.0
    assert weights([INSULT, OTHER, INSULT]) == [0.0, 0.0, 0.25] and weights([TARGET, INSULT, INSULT])[1:] == [0.5, 0.75]


def test_composition_equals_running_one_after_the_other():
    rng, parts = random.Random(3), toxicity.PARTS
    for _ in range(500):
        symbols = [rng.randrange(END + 1) for _ in range(30)]
        states, want = [p.start for p in parts], []
        for s in symbols:
            for k, part in enumerate(parts):
                states[k], s, _ = part.step(states[k], s)
            want.append(s)
        assert run(symbols) == want


def test_held_out_accuracy_and_labels_do_not_leak(spark):
    docs, labels = made(900, 5)
    d = spark.createDataFrame(docs, "doc_id long, text string, score int, label_ string").repartition(3)
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    train = l.where(~held_out("doc_id", 3, 1))
    model = toxicity.fit(d, train)
    assert "zorq*" in model.patterns and "grubber" in model.patterns
    rows = toxicity.score(d, model, [F.col("doc_id"), held_out("doc_id", 3, 1).alias("held_out")], F.col("text")).collect()
    truth = dict(labels)
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 200 and np.mean([(r.score >= 0.7) == truth[r.doc_id] for r in unseen]) > 0.98
    flipped = l.withColumn("toxic", F.when(held_out("doc_id", 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(d, flipped.where(~held_out("doc_id", 3, 1)))
    assert again.patterns == model.patterns and np.allclose(again.weights, model.weights)


def test_odd_rows(spark):
    docs, labels = made(300, 8)
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, score int, label_ string"), spark.createDataFrame([*labels, (None, 1), (1, None), (2, 7), (9999, 1)], "doc_id long, toxic int"))
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "grubber"), (3, "grubber " * 50_000), (4, "…\u0000\n")], "doc_id long, text string")
    rows = toxicity.score(odd, model, [F.col("doc_id")], F.col("text")).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and next(r for r in rows if r.doc_id == 3).score > 0.9
    assert toxicity.score(odd.limit(0), model, [F.col("doc_id")], F.col("text")).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.7 for r in toxicity.score(docs, model, [F.col("doc_id")], F.col("text")).collect())


def test_whole_table(spark):
    rows = queries.op5_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r.predicted == int(r.score >= 0.7) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    unseen = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in unseen]) > 0.95


def plain_features(patterns, text):
    """The clause sums by running each transducer's rule over the tokens, one after the other."""
    closed = {w: k for k, ws in toxicity.WORDS.items() for w in ws.split()}
    tokens, classes, weight = toxicity._TOKEN.findall(text.lower()), [], []
    for t in tokens:
        own = [patterns[p] for p in [t, *(t[:n] + "*" for n in toxicity.PREFIXES if len(t) >= n)] if p in patterns] if t not in ".!?;\n\"“”«»„" else []
        classes.append(END if t in ".!?;\n" else QUOTE if t in "\"“”«»„" else (THREAT if closed.get(t) == THREAT else INSULT) if own else closed.get(t, OTHER))
        weight.append(max(own) if own else float(closed.get(t) == THREAT))
    out = [0.0] * toxicity.FEATURES
    if INSULT not in classes and THREAT not in classes:
        return out
    classes.append(END)
    weight.append(0.0)
    for part in toxicity.PARTS:
        state = part.start
        for at, symbol in enumerate(classes):
            state, classes[at], extra = part.step(state, symbol)
            weight[at] += extra
    counted = lambda k: [w for c, w in zip(classes, weight) if c == k]
    clauses, clause = [], 0.0
    for c, w in zip(classes, weight):
        clause += w * (0.2 if c in (NEGATED, REPORTED) else 1.0) if c in toxicity.COUNTED else 0.0
        if c == END:
            clauses.append(clause)
            clause = 0.0
    total = sum(sum(counted(k)) for k in toxicity.COUNTED)
    return [*(np.log1p(sum(counted(k))) for k in toxicity.COUNTED), max(clauses), np.log1p(sum(c >= 1 for c in clauses)), np.log1p(total), np.log1p(100 * total / max(len(tokens), 20))]


def test_query_against_plain_python(spark):
    """The whole of op5 by loops: labels, near copies, pattern counts, weights, scores."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = sorted({(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id is not None and r.toxic in (0, 1) and r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 3 != 1})
    alone = {}
    for i, label in labels:
        alone.setdefault((toxicity.near_hash(docs[i]), label), docs[i])
    n, t = Counter(), Counter()
    for (_, label), text in alone.items():
        for p in toxicity.patterns_of(text):
            n[p] += 1
            t[p] += label
    toxic = sum(label for _, label in alone)
    clean = len(alone) - toxic
    odds = {p: np.log(((t[p] + 0.5) / (toxic + 1)) / ((n[p] - t[p] + 0.5) / (clean + 1))) for p in n if t[p] >= max(toxicity.MIN_SUPPORT, np.ceil(toxicity.MIN_SHARE * toxic))}
    patterns = {p: w for p, w in odds.items() if w >= toxicity.MIN_LOG_ODDS}
    x = np.array([plain_features(patterns, text) for text in alone.values()])
    w, mean, scale = toxicity._logistic(x, np.array([float(label) for _, label in alone]))
    got = queries.op5_toxicity(spark, sf).collect()
    assert len(got) == len(docs) and patterns
    for r in got:
        z = w[0] + sum(a * (b - m) / s for a, b, m, s in zip(w[1:], plain_features(patterns, docs[r.doc_id]), mean, scale))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(1, f"grubber {k % 9}") for k in range(3000)] + [(k, "green tree") for k in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 5 + [(k, 0) for k in range(2, 30)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert model.patterns == again.patterns and np.allclose(model.weights, again.weights)
    from panelwright.llm import common

    patterns = next(path for _, path in common._WRITTEN[::-1] if "/patterns-" in path)
    assert spark.read.parquet(patterns).where("pattern = '\n'").first().n == 2  # one toxic text, and one of all copies of the clean one


def test_closed_classes_can_be_replaced():
    lexicon = toxicity.Lexicon({}, {THREAT: "grob", NEGATION: "nix"})
    assert lexicon.features("grob")[1] > 0 and lexicon.features("nix grob")[2] > 0 and lexicon.features("kill") == [0.0] * toxicity.FEATURES
