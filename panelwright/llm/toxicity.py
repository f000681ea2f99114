"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps tokens to classes (insult, threat, target, negation, report,
intent, clause end, quote, other); insults and their weights are learned from
labels as words and word beginnings, the closed classes are word lists that
the caller may replace. Five transducers are composed over the classes: insults
weigh more in a row, threats after a word of intent; a negation turns what
follows into a negated insult or threat, reported speech into a reported one,
a target nearby into an aimed one. What the composed machine emits is summed
clause by clause; a logistic layer over the clause sums, fitted on the same
labelled rows, turns them into a calibrated score.

Fitting reads at most FIT_ROWS labelled rows, the least by hash of the id: a
documented bound that does not grow with the input. Of several texts under one
id that with the least digest counts. Near copies in it count once (by the least and greatest
hash of five-word shingles; the least id stays), else a passage that was
copied often would pass for an insult. A learned pattern must be in a share
MIN_SHARE of the toxic rows, which bounds how many there can be.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_where, sliced, small_batches, written

FIT_ROWS, MIN_SUPPORT, MIN_SHARE, MIN_LOG_ODDS = 12_000, 6, 0.01, 2.0
PREFIXES = (6, 5, 4)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, QUOTE, END = range(9)
NEGATED, REPORTED, AIMED = 9, 10, 11  # of insults and threats, made by the transducers

# Fixed word lists of the closed classes.
WORDS = {
    THREAT: "kill hurt destroy murder burn beat shoot stab tuer frapper détruire brûler töten schlagen vernichten verbrennen matar golpear destruir quemar",
    TARGET: "you your yourself u he she him her they them people everyone tu toi vous votre elle ils elles leur du dich dein ihr euch sie er ihn usted ustedes él ella ellos vosotros",
    NEGATION: "not no never nor without isn aren wasn don doesn didn won ne pas jamais sans aucun nicht kein keine nie niemals ohne nunca jamás sin tampoco",
    INTENT: "will shall gonna going must should vais va allons allez dois werde wird werden muss soll voy vas va vamos debe quiero want",
    REPORT: "said says say told wrote writes quoted quote called claimed reported dit disait écrit appelé sagte sagt schrieb nannte dijo dice escribió llamó",
}
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]|[\"“”«»„]")
_ENDS, _QUOTES = frozenset(".!?;\n"), frozenset("\"“”«»„")


class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol out, weight); what is not listed stays and passes through."""

    def __init__(self, moves: dict[tuple, tuple], start=0):
        self.moves, self.start = moves, start

    def step(self, state, symbol):
        return self.moves.get((state, symbol)) or (state, symbol, 0.0)

    def then(self, other: Transducer, symbols: range) -> Transducer:
        """Composition: this one's output is the other's input; reachable states only."""
        start = (self.start, other.start)
        moves, seen, todo = {}, {start}, [start]
        while todo:
            state = todo.pop()
            for symbol in symbols:
                a, middle, wa = self.step(state[0], symbol)
                b, out, wb = other.step(state[1], middle)
                moves[state, symbol] = ((a, b), out, wa + wb)
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return Transducer(moves, start)


def _decaying(kind: int, reach: int, moves: dict[tuple, tuple]) -> Transducer:
    """After ``kind`` a state counts down from ``reach``, to 0 at a clause end; ``moves`` come first."""
    own = {(s, kind): (reach, kind, 0.0) for s in range(reach + 1)}
    own |= {(s, k): (0 if k == END else s - 1, k, 0.0) for s in range(1, reach + 1) for k in range(AIMED + 1) if k != kind}
    return Transducer(own | moves)


def _insult(reach: int = 3) -> Transducer:
    """An insult up to ``reach`` tokens after another one weighs more."""
    return _decaying(INSULT, reach, {(s, INSULT): (reach, INSULT, 0.25) for s in range(1, reach + 1)})


def _threat(reach: int = 4) -> Transducer:
    """A threat up to ``reach`` tokens after a word of intent weighs more."""
    return _decaying(INTENT, reach, {(s, THREAT): (s - 1, THREAT, 0.5) for s in range(1, reach + 1)})


def _negation(reach: int = 3) -> Transducer:
    """An insult or threat up to ``reach`` tokens after a negation is a negated one."""
    moves = {(s, NEGATION): (reach, NEGATION, 0.0) for s in range(reach + 1)} | {(s, END): (0, END, 0.0) for s in range(1, reach + 1)}
    for s in range(1, reach + 1):
        moves |= {(s, k): (s - 1, NEGATED if k in (INSULT, THREAT) else k, 0.0) for k in range(END) if k != NEGATION}
    return Transducer(moves)


def _reported() -> Transducer:
    """After a report word and a quotation mark up to the next mark, insults are reported ones."""
    moves = {(0, REPORT): (1, REPORT, 0.0), (1, QUOTE): (2, QUOTE, 0.0), (2, QUOTE): (0, QUOTE, 0.0), (1, END): (0, END, 0.0), (2, END): (0, END, 0.0)}
    moves |= {(2, k): (2, REPORTED, 0.0) for k in (INSULT, THREAT, NEGATED)}
    return Transducer(moves)


def _target(reach: int = 4) -> Transducer:
    """An insult or threat up to ``reach`` tokens after a target is aimed and weighs more."""
    moves = {(s, TARGET): (reach, TARGET, 0.0) for s in range(reach + 1)} | {(s, END): (0, END, 0.0) for s in range(1, reach + 1)}
    for s in range(1, reach + 1):
        moves |= {(s, k): (s - 1, AIMED if k in (INSULT, THREAT) else k, 0.5 if k in (INSULT, THREAT) else 0.0) for k in range(AIMED) if k not in (TARGET, END)}
    return Transducer(moves)


PARTS = (_insult(), _threat(), _negation(), _reported(), _target())
GRAMMAR = reduce(lambda a, b: a.then(b, range(AIMED + 1)), PARTS)
COUNTED = (INSULT, THREAT, NEGATED, REPORTED, AIMED)
FEATURES = len(COUNTED) + 4


class Lexicon:
    """Word -> (class, weight); learned patterns are whole words or ``beginning*``."""

    def __init__(self, patterns: dict[str, float], words: dict[int, str] = WORDS):
        self.patterns, self.known = patterns, {}
        self.closed = {word: kind for kind, own in words.items() for word in own.split()}

    def look_up(self, word: str) -> tuple[int, float] | None:
        if word in _ENDS:
            return END, 0.0
        if word in _QUOTES:
            return QUOTE, 0.0
        weights = [self.patterns[p] for p in (word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)) if p in self.patterns]
        if weights:
            return (THREAT if self.closed.get(word) == THREAT else INSULT), max(weights)
        return (self.closed[word], 1.0 if self.closed[word] == THREAT else 0.0) if word in self.closed else None

    def features(self, text: str) -> list[float]:
        """Sums over the clauses that hold an insult or threat; all zero where there is none."""
        tokens, known = _TOKEN.findall(text.lower()), self.known
        if len(known) > 200_000:
            known.clear()
        seen = []
        for token in tokens:
            try:
                seen.append(known[token])
            except KeyError:
                known[token] = found = self.look_up(token)
                seen.append(found)
        out = [0.0] * FEATURES
        if not any(s is not None and s[0] in (INSULT, THREAT) for s in seen):
            return out
        state, clause, best, clauses = GRAMMAR.start, 0.0, 0.0, 0
        sums = dict.fromkeys(COUNTED, 0.0)
        for symbol, weight in (s or (OTHER, 0.0) for s in [*seen, (END, 0.0)]):
            state, kind, extra = GRAMMAR.step(state, symbol)
            if kind in sums:
                sums[kind] += weight + extra
                clause += (weight + extra) * (0.2 if kind in (NEGATED, REPORTED) else 1.0)
            elif kind == END:
                best, clauses, clause = max(best, clause), clauses + (clause >= 1), 0.0
        total = sum(sums.values())
        return [*(math.log1p(sums[k]) for k in COUNTED), best, math.log1p(clauses), math.log1p(total), math.log1p(100 * total / max(len(tokens), 20))]


def patterns_of(text: str) -> set[str]:
    words = {t for t in _TOKEN.findall(text.lower()) if len(t) > 2}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def near_hash(text: str) -> int:
    """The least and the greatest hash of the five-word shingles, as one number."""
    words = text.lower().split()
    hashes = [crc32(" ".join(words[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 4))]
    return min(hashes) << 31 ^ max(hashes)


class Model:
    def __init__(self, patterns: dict[str, float], weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, words: dict[int, str] = WORDS):
        self.patterns, self.weights, self.mean, self.scale, self.words = patterns, weights, mean, scale, words

    def lexicon(self) -> Lexicon:
        return Lexicon(self.patterns, self.words)

    def scores(self, lexicon: Lexicon, texts: list[str]) -> np.ndarray:
        x = np.array([lexicon.features(t) for t in texts]).reshape(-1, FEATURES)
        z = ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    design = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(design.shape[1])
    ridge = np.diag([1e-3, *[l2] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (p - y) + ridge @ w)
    return w, mean, scale


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", words: dict[int, str] = WORDS) -> Model:
    """Learn the lexicon and the score from labelled rows; labels outside 0 and 1 and null ids are not used.

    ``words``: the closed classes (THREAT, TARGET, NEGATION, REPORT, INTENT), each as words between blanks.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("label_")).distinct().orderBy(F.xxhash64("id_"), "id_", "label_").limit(FIT_ROWS)
    told = small_batches(docs).select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_")).join(F.broadcast(chosen), "id_")  # at most FIT_ROWS rows of two numbers
    sample = written(told.withColumn("digest_", F.md5("text_")).withColumn("place_", F.monotonically_increasing_id()), "toxicity")

    def hashed(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([near_hash(t) for t in batch.column(4).to_pylist()], pa.int64())], ["id_", "label_", "digest_", "place_", "near"])

    # Only numbers and digests are dealt out; then the places of the chosen rows, FIT_ROWS at most, go back to the texts.
    id_type = sample.schema["id_"].dataType.simpleString()
    narrow = sample.select("id_", "label_", "digest_", "place_", "text_").mapInArrow(hashed, f"id_ {id_type}, label_ int, digest_ string, place_ long, near long")
    single = narrow.groupBy("id_", "label_").agg(F.min(F.struct("digest_", "place_", "near")).alias("one"))
    places = single.groupBy("one.near", "label_").agg(F.min(F.struct("id_", "one.place_"))["place_"].alias("place_")).select("place_")
    alone = sample.join(F.broadcast(places), "place_", "left_semi")

    def counted(batches):
        for batch in sliced(batches):
            toxic, all_ = Counter(), Counter()
            for text, label in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                found = patterns_of(text)
                all_.update(found)
                all_["\n"] += 1
                if label:
                    toxic.update(found)
                    toxic["\n"] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(all_)), pa.array(list(all_.values()), pa.int64()), pa.array([toxic[k] for k in all_], pa.int64())], ["pattern", "n", "t"])

    counts = written(alone.select("label_", "text_").mapInArrow(counted, "pattern string, n long, t long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "patterns")
    whole = counts.where(F.col("pattern") == "\n").first()
    if whole is None or not 0 < whole["t"] < whole["n"]:
        rate = 0.0 if whole is None else whole["t"] / whole["n"]
        return Model({}, np.array([math.log((rate + 1e-4) / (1 - rate + 1e-4)), *[0.0] * FEATURES]), np.zeros(FEATURES), np.ones(FEATURES), words)
    toxic, clean = whole["t"], whole["n"] - whole["t"]
    odds = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("n") - F.col("t") + 0.5) / (clean + 1)))
    kept = counts.where((F.col("pattern") != "\n") & (F.col("t") >= max(MIN_SUPPORT, math.ceil(MIN_SHARE * toxic)))).withColumn("w", odds).where(F.col("w") >= MIN_LOG_ODDS).collect()  # no more than an average text has patterns, divided by MIN_SHARE
    patterns = {r["pattern"]: float(r["w"]) for r in kept}

    def shown(batches):
        lexicon = Lexicon(patterns, words)
        for batch in sliced(batches):
            x = [lexicon.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label_", "x"])

    rows = alone.select("label_", "text_").mapInArrow(shown, "label_ int, x array<double>").collect()  # at most FIT_ROWS short rows
    return Model(patterns, *_logistic(np.array([r["x"] for r in rows]), np.array([float(r["label_"]) for r in rows])), words)


def score(docs: DataFrame, model: Model, keys: list[Column], text: Column) -> DataFrame:
    """The key columns and ``score`` (0 to 1).

    Null and empty texts get the score of a text without a match; repeated
    rows are rows of their own; an empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    rows = small_batches(docs).select(*keys, text.alias("text_"))
    names = rows.columns[:-1]

    def scored(batches):
        lexicon = model.lexicon()
        for batch in sliced(batches):
            values = model.scores(lexicon, [t or "" for t in batch.column(len(names)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(values, pa.float64())], [*names, "score"])

    return rows.mapInArrow(scored, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double")


def clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """The documents whose score stays below the limit, with all their columns; null texts count as empty."""

    def make():
        lexicon = model.lexicon()
        return lambda texts: (model.scores(lexicon, texts) < limit).tolist()

    return kept_where(docs, text_col, make)
