"""Quality by ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(threshold_k - f(text)): one set of hashed weights,
shared by all grades, and ordered thresholds (the first free, the others by
positive steps). Features are hashed words, hashed token shapes and hashed
bands of whole-text ratios. The expected grade and the tail P(grade >= k)
serve for selection.

The tables hold no graded rating, so grade_of() makes one of the two labels:
0 bad quality, 1 good but toxic, 2 good and clean. Fitting reads at most
FIT_ROWS labelled rows, the least by hash of the id: a documented bound.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches

FIT_ROWS, BITS, STEPS, RATE, L2 = 8_000, 18, 240, 0.05, 1e-4
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha() and b != 32)
_RUNS = (re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[a-zß-öø-ÿ]+"), re.compile("[0-9]+"))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0, 1 or 2; null where a label is missing or not 0 or 1."""
    known = quality.isin(0, 1) & toxic.isin(0, 1)
    return F.when(known, F.when(quality == 0, 0).when(toxic == 1, 1).otherwise(2))


def _slot(name: str) -> int:
    return crc32(name.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def _shape(token: str) -> str:
    for run, letter in zip(_RUNS, "Aa0"):
        token = run.sub(letter, token)
    return token[:8]


class Hasher:
    """Token -> its slots; what was seen is remembered up to a bound."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def slots(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values of a text; empty texts have only their bands."""
        tokens = Counter(text.split())
        known = self.known
        if len(known) > 300_000:
            known.clear()
        words, shapes = [], Counter()
        n = sum(tokens.values())
        for token, count in tokens.items():
            pair = known.get(token)
            if pair is None:
                pair = known[token] = (_slot("w " + token.lower().strip(".,;:")), _slot("s " + _shape(token)))
            words.append(pair[0])
            shapes[pair[1]] += count
        data = text.encode("utf-8", "replace")
        chars, letters = max(len(data), 1), len(data.translate(None, _NOT_LETTERS))
        bands = [_slot(f"b {name} {band}") for name, band in (
            ("length", int(math.log2(n + 1))), ("variety", int(10 * len(tokens) / max(n, 1))), ("peak", int(10 * max(tokens.values(), default=0) / max(n, 1))),
            ("letters", int(20 * min(1, letters / chars))), ("word", min(20, int(chars / max(n, 1)))))]
        slots = np.array([*words, *shapes, *bands], np.int64)
        values = np.array([*[2 / math.sqrt(max(len(words), 1))] * len(words), *(math.sqrt(c / n) for c in shapes.values()), *[1.0] * len(bands)])
        return slots, values


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, hasher: Hasher, texts: list[str]) -> np.ndarray:
        """Per text P(grade >= 1), P(grade >= 2), ..."""
        f = np.array([float(v @ self.weights[s]) for s, v in map(hasher.slots, texts)])
        return 1 / (1 + np.exp(-np.clip(f[:, None] - self.thresholds[None], -30, 30)))


def _fitted(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int) -> Model:
    """Adam on the mean log-likelihood of the cumulative-link model."""
    slots = np.concatenate([s for s, _ in rows])
    used, column = np.unique(slots, return_inverse=True)
    values = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    share = [max((grades >= k).mean(), 1e-3) for k in range(1, n_grades)]
    start = np.array([-math.log(p / max(1 - p, 1e-3)) for p in share])
    theta = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        w, steps = theta[: len(used)], np.exp(theta[len(used) + 1 :])
        cuts = np.concatenate([[-np.inf], theta[len(used)] + np.concatenate([[0.0], np.cumsum(steps)]), [np.inf]])
        f = np.bincount(row, values * w[column], len(rows))
        upper, lower = sigmoid(np.where(np.isinf(cuts[grades + 1]), 30, cuts[grades + 1] - f)), sigmoid(np.where(np.isinf(cuts[grades]), -30, cuts[grades] - f))
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_cut = np.zeros(len(cuts))
        np.add.at(by_cut, grades + 1, -du / len(rows))
        np.add.at(by_cut, grades, dl / len(rows))
        inner = by_cut[1:-1]
        gradient = np.concatenate([np.bincount(column, values * ((du - dl) / len(rows))[row], len(used)) + L2 * w, [inner.sum()], np.cumsum(inner[:0:-1])[::-1] * steps])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = theta[: len(used)]
    return Model(weights, theta[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(used) + 1 :]))]))


def fit(docs: DataFrame, graded: DataFrame, n_grades: int = 3, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """Fit on rows of ``graded`` (id, grade) that have a document; null ids and grades are not used; of several texts under one id the least counts.

    Without any such row all weights are 0 and the thresholds even.
    """
    chosen = graded.where(F.col(id_col).isNotNull() & F.col(grade_col).between(0, n_grades - 1)).select(F.col(id_col).alias("id_"), F.col(grade_col).cast("int").alias("grade_")).distinct().orderBy(F.xxhash64("id_"), "id_", "grade_").limit(FIT_ROWS)

    def hashed(batches):
        hasher = Hasher()
        for batch in sliced(batches):
            made = [hasher.slots(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tolist() for s, _ in made], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in made], pa.list_(pa.float32()))], ["grade_", "s", "v"])

    sample = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).join(F.broadcast(chosen), "id_")  # FIT_ROWS rows of two numbers at most
    sample = sample.groupBy("id_", "grade_").agg(F.min("text_").alias("text_")).select("grade_", "text_")
    rows = sample.mapInArrow(hashed, "grade_ int, s array<int>, v array<float>").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(1 << BITS, np.float32), np.arange(n_grades - 1, dtype=float))
    return _fitted([(np.array(s.values), np.array(v.values)) for s, v in zip(rows["s"], rows["v"])], np.array(rows["grade_"]), n_grades)


def score(docs: DataFrame, model: Model, keys: list[Column], text: Column) -> DataFrame:
    """The key columns, ``tails`` (P(grade >= 1), ...) and ``expected_grade``, their sum.

    Null texts count as empty; repeated rows are rows of their own; an empty
    table gives no rows; other columns are not read.
    """
    rows = small_batches(docs).select(*keys, text.alias("text_"))
    names = rows.columns[:-1]

    def scored(batches):
        hasher = Hasher()
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            tails = model.tails(hasher, texts) if texts else np.zeros((0, len(model.thresholds)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(tails.tolist(), pa.list_(pa.float64())), pa.array(tails.sum(1))], [*names, "tails", "expected_grade"])

    return rows.mapInArrow(scored, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", tails array<double>, expected_grade double")
