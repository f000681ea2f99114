from __future__ import annotations

import random
import zlib

import numpy as np
from panelwright.llm import quality, queries
from panelwright.llm.common import held_out
from pyspark.sql import functions as F

GOOD = ["the", "house", "green", "river", "walks", "slowly", "and", "tree", "of", "stone", "light", "paper"]


def made(n, seed):
    """Grade 0: one word again and again; 1: shouted marks; 2: plain words."""
    rng = random.Random(seed)
    docs, grades = [], []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2])
        words = [rng.choice(GOOD) for _ in range(rng.randint(15, 60))]
        words = [words[0]] * len(words) if grade == 0 else [w.upper() + "!!" if rng.random() < 0.6 else w for w in words] if grade == 1 else words
        docs.append((i, " ".join(words), "tails", 3))
        grades.append((i, grade))
    return docs, grades


def test_held_out_grades(spark):
    docs, grades = made(900, 1)
    d, g = spark.createDataFrame(docs, "doc_id long, text string, tails string, grade int"), spark.createDataFrame(grades, "doc_id long, grade int")
    model = quality.fit(d, g.where(~held_out("doc_id", 3, 1)))
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.score(d, model, [F.col("doc_id"), held_out("doc_id", 3, 1).alias("h")], F.col("text")).collect()
    truth = dict(grades)
    unseen = [r for r in rows if r.h]
    assert len(unseen) > 200 and np.mean([round(r.expected_grade) == truth[r.doc_id] for r in unseen]) > 0.95
    assert all(1 >= r.tails[0] >= r.tails[1] >= 0 and abs(sum(r.tails) - r.expected_grade) < 1e-9 for r in rows)


def test_gradient_raises_the_likelihood_to_the_base_rates():
    """With one shared feature the fit can only learn the grades' shares."""
    rng = np.random.default_rng(0)
    grades = rng.choice(4, 3000, p=[0.1, 0.2, 0.3, 0.4])
    model = quality._fitted([(np.array([5]), np.array([1.0]))] * 3000, grades, 4)
    tails = 1 / (1 + np.exp(model.thresholds - model.weights[5]))
    assert np.allclose(tails, [(grades >= k).mean() for k in (1, 2, 3)], atol=0.02)


def test_grades(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0), (None, 1), (1, None), (7, 0)], "q int, t int").select(quality.grade_of(F.col("q"), F.col("t"))).collect()
    assert [r[0] for r in rows] == [0, 0, 1, 2, None, None, None]


def test_odd_rows(spark):
    docs, grades = made(200, 2)
    model = quality.fit(spark.createDataFrame(docs, "doc_id long, text string, tails string, grade int"), spark.createDataFrame([*grades, (None, 1), (3, None), (4, 9)], "doc_id long, grade int"))
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "tree " * 100_000), (5, "\u0000é | ###")], "doc_id long, text string")
    rows = quality.score(odd, model, [F.col("doc_id")], F.col("text")).collect()
    assert len(rows) == 5 and len({r.expected_grade for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.score(odd.limit(0), model, [F.col("doc_id")], F.col("text")).count() == 0
    empty = quality.fit(odd, spark.createDataFrame([], "doc_id long, grade int"))
    assert quality.score(odd, empty, [F.col("doc_id")], F.col("text")).count() == 5


def test_whole_table(spark):
    rows = queries.op8_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    unseen = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and np.mean([r.predicted == labels[r.doc_id] for r in unseen]) > 0.95


def test_query_against_plain_python(spark):
    """Tails of the whole of op8: folds, grades and features by loops, the link by its formula."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    graded = sorted({(r.doc_id, 0 if r.quality == 0 else 1 if r.toxic == 1 else 2) for r in labels if r.doc_id in docs and r.quality in (0, 1) and r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1})
    hasher = quality.Hasher()
    model = quality._fitted([hasher.slots(docs[i]) for i, _ in graded], np.array([g for _, g in graded]), 3)
    got = queries.op8_quality(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        f = sum(v * model.weights[s] for s, v in zip(*quality.Hasher().slots(docs[r.doc_id])))
        tails = [1 / (1 + np.exp(t - f)) for t in model.thresholds]
        assert abs(r.score - tails[0]) < 2e-3 and abs(r.top_tail - tails[1]) < 2e-3 and abs(r.expected_grade - sum(tails)) < 4e-3


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(1, f"tree {k % 9}") for k in range(3000)] + [(2, "HOUSE !!")], "doc_id long, text string")
    graded = spark.createDataFrame([(1, 2)] * 4 + [(2, 0)], "doc_id long, grade int")
    model, again = quality.fit(docs, graded), quality.fit(docs.where("doc_id = 2 OR text = 'tree 0'").dropDuplicates(), graded.distinct())
    assert np.allclose(model.weights, again.weights, atol=1e-5) and np.allclose(model.thresholds, again.thresholds, atol=1e-5)
