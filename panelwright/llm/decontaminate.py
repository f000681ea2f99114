"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A first pass counts in how many documents each benchmark n-gram occurs. The
rarest of an item's n-grams, by that count over all documents, are its seeds:
a passage that itself leaked into many documents keeps seeds, common phrases
become few. A second pass joins documents to items on seeds and aligns the
item with the stretch of text around its seeds; coverage is the share of the
item's words that the best local alignment matches exactly.

Recall: to stay at coverage c an item of m words can lose at most (1 - c) m of
them. A replaced or missing word breaks at most GRAM n-grams, a word put in
between breaks GRAM - 1, so an item has GRAM floor((1 - c) m) + 1 seeds: no
choice of replaced and missing words that leaves the coverage hits all of
them, nor do words put in at fewer than about a third of the places.

The benchmark is the stated query set: it is read in blocks of at most about
BLOCK_ITEMS items and BLOCK_BYTES of text, each small enough for every task;
documents are streamed and never shuffled. Only per-partition n-gram counts
move. Each block costs two scans of the documents.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_where, sliced, small_batches

GRAM, MIN_WORDS, COVERAGE, BLOCK_ITEMS, BLOCK_BYTES = 3, 5, 0.8, 20_000, 16 << 20
#: Alignment scores of an equal word, a word with the same beginning, another word, a gap.
EQUAL, ALIKE, UNEQUAL, GAP = 4, 1, -2, 2
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Items:
    """A block of benchmark items, indexed by n-gram."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, t in rows]
        self.words = [words_of(t) for _, t in rows]
        vocabulary = sorted({w for ws in self.words for w in ws})
        self.number = {w: k for k, w in enumerate(vocabulary, 1)}
        self.base = len(vocabulary) + 1
        self.beginning = {b: k for k, b in enumerate(sorted({w[:4] for w in vocabulary if len(w) >= 4}), 1)}
        self.coded = [np.array([self.number[w] for w in ws], np.int64) for ws in self.words]
        self.sizes = sorted({self.gram(k) for k in range(len(rows))}) or [GRAM]
        grams = defaultdict(list)
        for k, codes in enumerate(self.coded):
            for at, gram in enumerate(self.grams(codes, self.gram(k))):
                grams[int(gram)].append((k, at))
        self.codes = np.array(sorted(grams), np.int64)
        self.places = [grams[int(c)] for c in self.codes]
        self.seed = [[True] * len(p) for p in self.places]

    def gram(self, k: int) -> int:
        """Words in an n-gram of item k: GRAM, fewer where so few of those could all be broken."""
        m = len(self.words[k])
        return next((n for n in range(GRAM, 1, -1) if m - n + 1 > n * _lost(m)), 1)

    def grams(self, codes: np.ndarray, size: int = GRAM) -> np.ndarray:
        """A number for each run of ``size`` words; 0 where one of them is in no item."""
        if len(codes) < size:
            return np.zeros(0, np.int64)
        out, known = np.zeros(len(codes) - size + 1, np.int64), np.ones(len(codes) - size + 1, bool)
        for k in range(size):
            part = codes[k : len(codes) - size + 1 + k]
            out, known = out * self.base + part, known & (part > 0)
        return np.where(known, out, 0)

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's n-grams that some item has, and their index in ``codes``."""
        get = self.number.get
        coded = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        places, found = [], []
        for size in self.sizes:
            grams = self.grams(coded, size)
            at = np.flatnonzero(grams)
            if len(at) and len(self.codes):
                where = np.searchsorted(self.codes, grams[at])
                own = (where < len(self.codes)) & (self.codes[np.minimum(where, len(self.codes) - 1)] == grams[at])
                places.append(at[own])
                found.append(where[own])
        nothing = [np.zeros(0, np.int64)]
        return np.concatenate(places or nothing), np.concatenate(found or nothing)

    def choose_seeds(self, frequency: dict[int, int]) -> None:
        """Keep as seeds, of each item, its rarest n-grams by document frequency: one more than edits can break, and those as rare."""
        counts = [frequency.get(int(c), 0) for c in self.codes]
        of_item = defaultdict(list)
        for code, places in enumerate(self.places):
            for k, _ in places:
                of_item[k].append(counts[code])
        limit = {k: sorted(v)[min(self.gram(k) * _lost(len(self.words[k])), len(v) - 1)] for k, v in of_item.items()}
        self.seed = [[counts[code] <= limit[k] for k, _ in places] for code, places in enumerate(self.places)]

    def matches(self, words: list[str]) -> list[tuple[float, int, int, int, int]]:
        """(coverage, item number, score, first word, end word) of items that a seed brings, best place of each.

        Places are aligned from the highest bound() down, to where the bounds
        fall under both COVERAGE and the best coverage found: what is left
        out is neither contaminated nor the best.
        """
        at, code = self.hits(words)
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, c in zip(at.tolist(), code.tolist()):
            for (k, item_at), seed in zip(self.places[c], self.seed[c]):
                if seed:
                    slack = len(self.words[k]) // 2 + 5
                    near[k].append((max(0, p - item_at - slack), p - item_at + len(self.words[k]) + slack))
        places = [(self.bound(k, words[start:end]), k, start, end) for k, windows in near.items() for start, end in _cut(_merged(windows), len(self.words[k]))]
        best: dict[int, tuple[float, int, int, int, int]] = {}
        most = 0.0
        for bound, k, start, end in sorted(places, key=lambda p: -p[0]):
            if bound < min(COVERAGE, most):
                break
            found = self.align(k, words[start:end])
            found = (found[0], k, found[1], start + found[2], start + found[3])
            best[k] = max(best.get(k, found), found, key=lambda f: (f[0], f[2], -f[3]))
            most = max(most, found[0])
        return list(best.values())

    def bound(self, k: int, text: list[str]) -> float:
        """The longest common subsequence of item k and these words, as a share of the item: no alignment matches more words in order."""
        masks: dict[str, int] = {}
        for i, w in enumerate(self.words[k]):
            masks[w] = masks.get(w, 0) | 1 << i
        full = (1 << len(self.words[k])) - 1
        rows = full
        for mask in filter(None, map(masks.get, text)):
            hit = rows & mask
            rows = (rows + hit | rows - hit) & full
        return (len(self.words[k]) - rows.bit_count()) / len(self.words[k])

    def align(self, k: int, text: list[str]) -> tuple[float, int, int, int]:
        """(coverage, score, first, end) of the best local alignment of item k with these words.

        Of equal scores the one with more equal words, then the later start.
        The three are one number per cell, so two rows of the table are
        enough: memory grows with the words of the item, not their square.
        """
        item, n = self.words[k], len(text)
        wide = 2 * (n + 2 * len(item)) >= 1 << 20 or n >= 1 << 21
        kind, low, one = (object, 64, 1) if wide else (np.int64, 21, np.int64(1))
        score, equal = one << 2 * low, one << low
        place = np.arange(1, n + 1).astype(kind)
        codes = np.fromiter((self.number.get(w, 0) for w in text), np.int64, n)
        begins = np.fromiter((self.beginning.get(w[:4], 0) if len(w) >= 4 else 0 for w in text), np.int64, n)
        fresh = np.arange(n + 1).astype(kind)  # nothing aligned: no score, and a start here
        slope = GAP * score * place
        above, best, end = fresh, fresh[0], 0
        steps: dict[str, np.ndarray] = {}
        for word in item:
            if word not in steps:
                if len(steps) > 64:  # a bounded number of rows
                    steps.clear()
                begin = self.beginning.get(word[:4], 0) if len(word) >= 4 else -1
                steps[word] = np.where(codes == self.number[word], EQUAL * score + equal, np.where(begins == begin, ALIKE * score, UNEQUAL * score)).astype(kind)
            row = fresh.copy()
            row[1:] = np.maximum(np.maximum(above[:-1] + steps[word], above[1:] - GAP * score), fresh[1:])
            row[1:] = np.maximum.accumulate(row[1:] + slope) - slope
            at = int(row.argmax())
            if row[at] > best and row[at] >= score:
                best, end = row[at], at
            above = row
        best = int(best)
        return (best >> low) % (1 << low) / len(item), best >> 2 * low, best % (1 << low), end


def _lost(m: int) -> int:
    """How many of m words an alignment may leave out and still have the coverage."""
    return int((1 - COVERAGE) * m + 1e-9)


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(windows):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut(windows: list[tuple[int, int]], m: int) -> list[tuple[int, int]]:
    """Long windows in overlapping pieces, so that memory stays bounded where a text repeats an item again and again.

    An alignment of an item of m words is at most m + m EQUAL / GAP words long, and stays whole in a piece.
    """
    longest = m + m * EQUAL // GAP
    out = []
    for start, end in windows:
        while end - start > 4 * longest:
            out.append((start, start + 4 * longest))
            start += 3 * longest
        out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["bytes"] // BLOCK_BYTES))
    for b in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield Items([(r.item, r.text) for r in own.where("item IS NOT NULL").orderBy("item", "text").collect() if len(words_of(r.text)) >= MIN_WORDS])


def _frequencies(texts: DataFrame, items: Items) -> dict[int, int]:
    """Documents that hold each n-gram of the block, counted over all documents."""

    def count(batches):
        total = np.zeros(len(items.codes), np.int64)
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                total[np.unique(items.hits(words_of(text or ""))[1])] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(items.codes[some]), pa.array(total[some])], ["code", "n"])

    rows = small_batches(texts).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r["code"]: r["n"] for r in rows.collect()}  # at most the block's n-grams


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that no item of the benchmark covers, with all their columns; see contamination()."""
    out = docs
    for items in _blocks(benchmark, item_col, item_text):
        items.choose_seeds(_frequencies(docs.select(text_col), items))

        def make(items=items):
            return lambda texts: [all(f[0] < COVERAGE for f in items.matches(words_of(t))) for t in texts]

        out = kept_where(out, text_col, make)
    return out


FOUND = "item_id long, coverage double, score long, first_word long, end_word long, n_items long"


def contamination(docs: DataFrame, benchmark: DataFrame, keys: list[Column], text: Column, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The key columns, the best matching item per document with its place, and ``contaminated``.

    - contaminated: coverage is at least COVERAGE; n_items counts the items
      that reach it. The best item has the highest coverage, then score,
      then least id; documents that no seed brings near an item have null
      item, coverage 0 and an empty place.
    - Words are runs of letters and digits, lower-cased. Items of fewer than
      MIN_WORDS words, with null text or id identify no passage and take no
      part; repeated items count once each.
    - Null and empty texts match nothing; repeated rows are rows of their
      own; an empty table of documents gives no rows, an empty benchmark
      contaminates none; other columns are not read.
    """
    rows = small_batches(docs).select(*keys, text.alias("text_"))
    names = rows.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    parts = []
    for items in _blocks(benchmark, item_col, item_text):
        items.choose_seeds(_frequencies(rows.select("text_"), items))

        def find(batches, items=items):
            for batch in sliced(batches):
                out = []
                for text in batch.column(len(names)).to_pylist():
                    found = items.matches(words_of(text)) if text else []
                    if found:
                        best = min(found, key=lambda f: (-f[0], -f[2], items.ids[f[1]]))
                        out.append((items.ids[best[1]], best[0], best[2], best[3], best[4], sum(f[0] >= COVERAGE for f in found)))
                    else:
                        out.append((None, 0.0, 0, 0, 0, 0))
                columns = list(zip(*out)) or [[]] * 6
                types = [pa.int64(), pa.float64(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *(pa.array(c, t) for c, t in zip(columns, types))], [*names, *(f.split(" ")[0] for f in FOUND.split(", "))])

        parts.append(rows.mapInArrow(find, f"{schema}, {FOUND}"))
    out = parts[0]
    if len(parts) > 1:  # one row per document again: the best block's, with the items of all
        place = [F.monotonically_increasing_id().alias("place_")]
        out = parts[0].select("*", *place)
        for more in parts[1:]:
            out = out.unionByName(more.select("*", *place))
        best = F.max(F.struct("coverage", "score", (-F.col("item_id")).alias("negative"), "item_id", "first_word", "end_word"))
        out = out.groupBy("place_", *[F.col(f"`{n}`") for n in names]).agg(best.alias("best"), F.sum("n_items").alias("n_items")).select(*[F.col(f"`{n}`") for n in names], "best.item_id", "best.coverage", "best.score", "best.first_word", "best.end_word", "n_items")
    return out.withColumn("contaminated", F.col("coverage") >= COVERAGE)
