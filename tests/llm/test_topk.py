from __future__ import annotations

import math
import random

import pytest
from panelwright.llm import queries, topk
from pyspark.sql import functions as F


def brute(rows, asked, k):
    out = []
    for q, qv in asked:
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q and len(v) == len(qv))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_ties_dimensions_and_repeats(spark, monkeypatch, small):
    if small:  # many blocks and strips
        for name, value in (("BLOCK", 16), ("QUERY_BLOCK", 3), ("STRIP", 4), ("PIVOTS", 5)):
            monkeypatch.setattr(topk, name, value)
    rng = random.Random(9)
    rows = [(i, [rng.randint(-9, 9) for _ in range(6)]) for i in range(300)]
    rows += [(i, [5] * 6) for i in range(300, 500)] + [(500 + i, [1, i]) for i in range(6)] + [(600, [7] * 6), (600, [7] * 6), (701, [10**9] * 6)]
    df = spark.createDataFrame([*rows, (800, None), (None, [1] * 6)], "vec_id long, vec array<long>").withColumn("dim", F.lit("clash"))
    asked = [r for r in dict(rows).items() if r[0] % 20 == 0]
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 7).collect()
    assert sorted(map(tuple, got)) == brute(rows, asked, 7)


def test_quantized(spark):
    rows = [[0.5, -0.001], None, [None, 1.0], [float("nan")], [math.inf], []]
    df = spark.createDataFrame([(r,) for r in rows], "e array<float>")
    assert [r[0] for r in df.select(topk.quantized(F.col("e"))).collect()] == [[32, -1], None, None, None, None, None]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, vec array<long>")
    full = spark.createDataFrame([(1, [1, 2])], "vec_id long, vec array<long>")
    assert topk.top_k(df, df, 3).count() == 0 and topk.top_k(df, full, 3).count() == 0 and topk.top_k(full, df, 3).count() == 0 and topk.top_k(full, full, 3).count() == 0


def test_far_annuli_are_not_expanded():
    """The bound holds for every member and prunes clustered data."""
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.integers(-60, 60, (400, 8))
    longest = float((data**2).sum(1).max())
    points = np.hstack([data[:3].astype(float), np.sqrt(longest - (data[:3] ** 2).sum(1))[:, None]])
    away = topk._distances(data, points, np.sqrt(longest - (data**2).sum(1)))
    queries = rng.integers(-60, 60, (50, 8))
    for p in range(3):
        own = away[:, p] < np.median(away[:, p])
        assert (topk._reach(queries, points, longest, p, away[own, p].min(), away[own, p].max())[:, None] >= queries @ data[own].T).all()


def test_whole_table(spark):
    rows = [(r.vec_id, [math.floor(64 * x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = queries.op10_topk(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == brute(rows, [r for r in rows if r[0] % 20 == 0], 20)


def test_large_finite_components_take_part(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e8, 1.0]), (2, [-1e30, 2.0]), (3, [3.5, 4.0]), (20, [1.0, -2.0]), (40, [1e8, 3.0]), (60, [1e15, -1e15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.select("vec_id", topk.quantized(F.col("embedding")).alias("vec")), df.where("vec_id % 20 = 0").select("vec_id", topk.quantized(F.col("embedding")).alias("vec")), 3).collect()
    clip = lambda x, most: max(-(2**63), min(most, x))
    whole = {i: [clip(math.floor(64 * x), 2**63 - 1024) for x in v] for i, v in rows}
    want = []
    for q in (0, 20, 40, 60):
        scored = sorted((-clip(sum(a * b for a, b in zip(whole[q], v)), 2**63 - 1), i) for i, v in whole.items() if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:3])]
    assert sorted(map(tuple, got)) == want


def test_a_repeated_query_id_asks_with_its_least_vector(spark):
    df = spark.createDataFrame([(20, [5, 1]), (20, [1, 9]), (1, [3, 0]), (2, [0, 3])], "vec_id long, vec array<long>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 20"), 1).collect()] == [(20, 1, 2, 27)]


def test_products_are_exact():
    import numpy as np

    rng = random.Random(5)
    a = np.array([[rng.randint(-(2**e), 2**e) for _ in range(5)] for e in (3, 20, 30, 45, 62)])
    b = np.array([[rng.randint(-(2**e), 2**e) for _ in range(5)] for e in (3, 20, 30, 45, 62) for _ in range(4)] + [[-(2**63)] * 5])
    want = [[max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(p, q)))) for q in b.tolist()] for p in a.tolist()]
    assert topk._products(a, b).tolist() == want
