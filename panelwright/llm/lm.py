"""Language-model scoring: context mixing over words, adapted to each document.

Fitting gathers the training words and their counts (partial counts per task,
then one shuffle), fills the bit predictors' hashed tables from the distinct
words, learns the mixing weights by online gradient steps in each task and
averages them, and counts the refining map; see mixing.py. Every training
word takes part; the model itself has a fixed size.

Scoring: a document is its lower-cased words and an end. The mixer gives each
distinct word its spelling probability s(w), remembered by the worker. The
document's own history then adapts it: after t words of which k were w,
P(w) = (k + r s(w)) / (t + r). Four rates r run side by side as an online
Bayesian mixture, so the better one for the document takes over. In s(w) the
probability of the first two bytes is adapted likewise, to the beginnings of
the document's new words so far (which tells its language).

Across words, a hashed context of three words predicts what follows it. A text
is cut after each run of CONTEXT words whose hash falls in one of CUT classes
(and after the first such run), so equal passages are cut alike wherever they
stand. The predictor's table, gathered from all training texts, holds for each
context the stretch up to the next cut that most training documents have
there. One binary decision says whether the stretch at hand is that one:
P(stretch) = p [it is] + (1 - p) P(its words). p is gated by the context's
counts (how many documents, which share), set by an adaptive map counted over
the training documents, and refined by the decisions of the document so far.
A training document is never predicted by itself: it is taken out of the
counts first. This table grows with the corpus; it is joined, not sent.

All of this is a distribution over word sequences (stretches count as equal by
a 64-bit hash); divided by the text's bytes its negative log2 is the bits per
byte.

The add-0.1 unigram base needs exact counts of all words. The most frequent,
at most TOP, travel with the tasks (a fixed bound); the rest of a document's words
are looked up by a join with the whole count table.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, written
from .mixing import BITS, MAP_STEPS, Code, Counts, Mixer, packed, refinement

TOP, RATES, REMEMBERED = 300_000, (30.0, 150.0, 700.0, 4000.0), 150_000
#: Distinct words that one task turns into tables; slots of one shuffled piece of a table.
WORDS_PER_TASK, PIECE = 400_000, 1 << 16
#: Weight of the static probability of a word's first two bytes against those of the document's new words.
START_RATE = 20.0
#: Documents whose words are held at a time.
ROWS = 200
#: Words in a context, one cut in so many contexts, classes of the adaptive map by documents and by share, its own and the map's weight.
CONTEXT, CUT, SUPPORTS, SHARES, MAP_PRIOR, MAP_RATE = 3, 16, 8, 10, 2.0, 1.0
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_HELD = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space; the end is the empty word, added by the callers."""
    return (text or b"").translate(_LOWER).split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of a one-column table of texts, ends included as ''."""

    def count(batches):
        held: Counter = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return out

        for batch in sliced(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.update(words_of(text))
                held[b""] += 1
                if len(held) > _HELD:
                    yield flushed()
        yield flushed()

    return small_batches(texts).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _columns(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).cast(pa.binary()).to_pylist(), np.array(batch.column(1)).astype(float)


def _tables(words: DataFrame, code: Code) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Packed entries of each predictor, and pairs of such with one 0 and with one 1 taken away."""

    def fill(batches):
        counts, some = Counts(code), False
        for names, times in _columns(batches):
            counts.add(names, times)
            some = True
        press = zstandard.ZstdCompressor(level=1)
        for k, n in enumerate(counts.n if some else []):
            for at in range(0, n.shape[1], PIECE):
                part = n[:, at : at + PIECE]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int64()), pa.array([press.compress(part.tobytes())], pa.binary())], ["k", "at", "part"])

    def add(frames):
        held, total = None, None
        unpress = zstandard.ZstdDecompressor()

        def done():
            n0, n1 = total.astype(float)
            entries = [packed(n0, n1), packed(np.maximum(n0 - 1, 0), n1), packed(n0, np.maximum(n1 - 1, 0))]
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int64()), *(pa.array([e.tobytes()], pa.binary()) for e in entries)], ["k", "at", "full", "less0", "less1"])

        for batch in frames:
            for k, at, part in zip(*(batch.column(c).to_pylist() for c in range(3))):
                n = np.frombuffer(unpress.decompress(part), np.int64).reshape(2, -1)
                if (k, at) == held:
                    total = total + n
                else:
                    if held is not None:
                        yield done()
                    held, total = (k, at), n
        if held is not None:
            yield done()

    summed = words.mapInArrow(fill, "k int, at long, part binary").repartition("k", "at").sortWithinPartitions("k", "at").mapInArrow(add, "k int, at long, full binary, less0 binary, less1 binary")
    empty = packed(np.zeros(1), np.zeros(1))[0]
    full = [np.full(1 << b, empty, np.uint16) for b in BITS]
    less = [np.full((2, 1 << b), empty, np.uint16) for b in BITS]
    for row in summed.collect():  # SLOTS entries of six bytes, whatever the input
        part = slice(row["at"], row["at"] + min(PIECE, 1 << BITS[row["k"]]))
        full[row["k"]][part] = np.frombuffer(row["full"], np.uint16)
        less[row["k"]][0, part] = np.frombuffer(row["less0"], np.uint16)
        less[row["k"]][1, part] = np.frombuffer(row["less1"], np.uint16)
    return full, less


def _frequent(words: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, at most TOP, and their counts: those above a limit that a histogram of the counts gives, so none are sorted."""
    step = F.floor(64 * F.log2("c"))
    found = sorted(((r["step"], r["n"]) for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # 64 rows for each doubling
    limit, held = float("inf"), 0
    for at, n in found:
        held += n
        if held > TOP:
            break
        limit = at
    top = words.where(step >= F.lit(limit)).toArrow()
    names, counts = top.column("word").cast(pa.binary()).to_pylist(), top.column("c").to_numpy().astype(float)
    order = sorted(range(len(names)), key=lambda k: (-counts[k], names[k]))
    return [names[k] for k in order], counts[order]


def _facts(mixer: Mixer, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per word log10 of its static probability and of that of its first two bytes, and a number for these two bytes."""
    whole, start = mixer.log10(words) if words else (np.zeros(0), np.zeros(0))
    return np.stack([whole, start], 1), np.array([int.from_bytes((w + b" ")[:2]) for w in words], np.int64)


class Model:
    """The mixer, N, V, and for the TOP words log10(count + 0.1) and what _facts says."""

    def __init__(self, mixer: Mixer, n: int, v: int, top: dict[bytes, int]):
        self.mixer, self.n, self.v = mixer, n, v
        self.index = {w: k for k, w in enumerate(top)}
        self.logs = np.log10(np.array(list(top.values()), float) + 0.1)
        self.facts, self.starts = _facts(mixer, list(top))
        self.hashes = hashes_of(list(top))


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of a one-column table of training texts (null: empty), and its table of word counts.

    Without any text the mixer knows nothing and N and V are 0.
    """
    words = written(word_counts(texts), "words")
    whole = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = whole["n"] or 0, whole["v"]
    names, counts = _frequent(words)
    code = Code.of_words(names, counts)
    dealt = written(words.repartition(max(1, -(-v // WORDS_PER_TASK))), "dealt")
    full, less = _tables(dealt, code)

    def learn(batches):
        mixer, size, seen = Mixer(code, less), 0, 0
        for names, times in _columns(batches):
            seen = seen + mixer.learn(names, times)
            size += len(names)
        if size:
            flat = mixer.weights.reshape(-1).astype(float) * size
            found = np.flatnonzero(seen.reshape(-1))
            at = np.concatenate([np.arange(len(flat)), len(flat) + found, [-1]])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([flat, seen.reshape(-1)[found], [size]]))], ["at", "x"])

    mixer = Mixer(code, less)
    learned = np.zeros(mixer.weights.size + 2 * 255 * (MAP_STEPS + 1) + 1)
    for row in dealt.mapInArrow(learn, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # one row per weight and cell of the map
        learned[row["at"]] = row["x"]
    weights = (learned[: mixer.weights.size] / learned[-1]).reshape(mixer.weights.shape) if learned[-1] else mixer.weights
    refine = refinement(learned[mixer.weights.size : -1].reshape(2, 255, -1))
    return Model(Mixer(code, full, weights, refine), n, v, dict(zip(names, counts.astype(int).tolist()))), words


def _before(keys: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """For each place, how many marked places before it have the same key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    count = np.cumsum(marked[order]) - marked[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.empty(len(keys))
    out[order] = count - np.repeat(count[begins], np.diff(np.append(begins, len(keys))))
    return out


def adapted(ids: np.ndarray, starts: np.ndarray, spelling: np.ndarray, start_p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each document's words in order; the documents stand one after the other, ``sizes`` words each.

    ids and starts number each word and its first two bytes (both below
    2^31); spelling and start_p are the static probabilities of the two.
    """
    return adapted_logs(ids, starts, np.log10(spelling), np.log10(start_p), sizes)


def adapted_logs(ids: np.ndarray, starts: np.ndarray, spelling: np.ndarray, start_p: np.ndarray, sizes: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """adapted() with log10 of the static probabilities, which may be too small for a float.

    Where ``ends`` gives places of words (ascending, with each document's
    last one): log10 of the words of a document up to each of them.
    """
    begins = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    t = np.arange(len(ids)) - begins[doc]
    k = _before(doc << 31 | ids, np.ones(len(ids)))
    new = (k == 0).astype(float)
    news = np.cumsum(new) - new
    news -= news[begins][doc]
    s = np.log10((_before(doc << 31 | starts, new) + START_RATE * 10.0**start_p) / (news + START_RATE)) + (spelling - start_p)
    # A new word's r s(w) stays a logarithm; beside a count of one or more, what a float loses of it is nothing.
    apart, share = np.where(k == 0, s, 0.0), 10.0 ** np.where(k == 0, 0.0, s)
    ends = begins + sizes - 1 if ends is None else ends
    totals = np.empty((len(RATES), len(ends)))
    for n, r in enumerate(RATES):
        whole = np.cumsum(np.log10((k + r * share) / (t + r)) + apart)
        totals[n] = whole[ends] - np.where(begins > 0, whole[begins - 1], 0.0)[doc[ends]]
    best = totals.max(0)
    return best + np.log10(np.mean(10.0 ** (totals - best), 0))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def stretches(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents as word hashes one after the other: each stretch's document, last word, hash and the hash of the context before it (0: none)."""
    n = len(hashes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    t = np.arange(n) - begins[doc]
    context = hashes * _MIX[0]
    for back in range(1, CONTEXT):
        context[back:] += hashes[:-back] * _MIX[back]
    context ^= context >> np.uint64(31)
    context *= _STEP
    last = np.zeros(n, bool)
    last[begins + sizes - 1] = True
    ends = np.flatnonzero(last | (t == CONTEXT - 1) | ((t >= CONTEXT) & (context >> np.uint64(32) < np.uint64((1 << 32) // CUT))))
    first = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])[: len(ends)]
    lengths = ends - first + 1
    powers = np.multiply.accumulate(np.full(int(lengths.max(initial=0)) + 1, _STEP))
    whole = np.add.reduceat(hashes * powers[np.arange(n) - np.repeat(first, lengths)], first) if n else hashes
    before = np.where(t[first] > 0, context[first - 1], np.uint64(0))
    return doc[ends], ends, whole, before


SCHEMA = "row_no long, n_bytes long, n_tokens long, top_known long, top_log double, score double, rare array<struct<word:string,n:long>>, stretches array<struct<context:long,stretch:long,log:double>>"


def score(docs: DataFrame, model: Model, words: DataFrame, keys: list[Column], text: Column, learned: Column | None = None) -> DataFrame:
    """The key columns, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``learned`` is true for the training texts among ``docs``: the table of
    contexts is gathered from them. Without it no context crosses a word.
    Null and empty texts are one token, the end, and have null bits per byte;
    a null ``learned`` counts as false; repeated rows are rows of their own;
    an empty table gives no rows; other columns are not read.
    """
    rows = small_batches(docs).select(*keys, text.alias("text_"), F.coalesce(F.lit(False) if learned is None else learned, F.lit(False)).alias("learned_"))
    names = rows.columns[:-2]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])

    def scored(batches):
        mixer, n_top = model.mixer, len(model.index)
        number = TaskContext.get().partitionId() << 33
        facts, starts, hashes = np.zeros((n_top + REMEMBERED, 2)), np.zeros(n_top + REMEMBERED, np.int64), np.zeros(n_top + REMEMBERED, np.uint64)
        facts[:n_top], starts[:n_top], hashes[:n_top] = model.facts, model.starts, model.hashes
        index, others = model.index, []  # others: the words of the rows from n_top on
        for batch in sliced(batches, ROWS):
            texts = batch.column(len(names)).cast(pa.binary()).to_pylist()
            split = [[*words_of(t), b""] for t in texts]
            fresh = list({w for ws in split for w in ws if w not in index})
            if len(others) + len(fresh) > len(facts) - n_top:  # forget all but the TOP words
                for w in others:
                    del index[w]
                others = []
                fresh = list({w for ws in split for w in ws if w not in index})
                if len(fresh) > len(facts) - n_top:
                    size = n_top + 2 * len(fresh)
                    facts, starts, hashes = np.resize(facts, (size, 2)), np.resize(starts, size), np.resize(hashes, size)
            if fresh:
                rows_ = slice(n_top + len(others), n_top + len(others) + len(fresh))
                facts[rows_], starts[rows_] = _facts(mixer, fresh)
                hashes[rows_] = hashes_of(fresh)
                index.update(zip(fresh, range(rows_.start, rows_.stop)))
                others += fresh
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            ids = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            rare = ids >= n_top
            found = np.zeros(len(ids))
            found[~rare] = model.logs[ids[~rare]]
            begins = np.cumsum(sizes) - sizes
            total = np.add.reduceat(found, begins) if len(sizes) else ()
            n_rare = np.add.reduceat(rare.astype(np.int64), begins) if len(sizes) else ()
            owner, ends, whole, before = stretches(hashes[ids], sizes)
            to_end = adapted_logs(ids, starts[ids], facts[ids, 0], facts[ids, 1], sizes, ends) if len(sizes) else np.zeros(0)
            lasts = np.searchsorted(owner, np.arange(len(sizes)), side="right") - 1
            told = np.flatnonzero(before)
            cuts = np.searchsorted(owner[told], np.arange(len(sizes) + 1)).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(before[told].view(np.int64)), pa.array(whole[told].view(np.int64)), pa.array(to_end[told] - to_end[told - 1])], ["context", "stretch", "log"])
            doc = np.repeat(np.arange(len(sizes)), sizes)[rare]
            pairs, times = np.unique(doc << 31 | ids[rare], return_counts=True)
            offsets = np.searchsorted(pairs >> 31, np.arange(len(sizes) + 1)).astype(np.int32)
            rare_words = pa.array([others[k - n_top] for k in (pairs & (1 << 31) - 1).tolist()], pa.binary()).cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([rare_words, pa.array(times, pa.int64())], ["word", "n"]))
            numbers = number + np.arange(len(sizes))
            number += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(names))), batch.column(len(names) + 1), pa.array(numbers, pa.int64()), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(sizes), pa.array(sizes - n_rare, pa.int64()), pa.array(total, pa.float64()), pa.array(to_end[lasts], pa.float64()), lists, pa.ListArray.from_arrays(pa.array(cuts), parts)],
                [*names, "learned_", "row_no", "n_bytes", "n_tokens", "top_known", "top_log", "score", "rare", "stretches"],
            )

    done = written(rows.mapInArrow(scored, ", ".join(filter(None, [schema, "learned_ boolean", SCHEMA]))), "scored")
    rare = done.select("row_no", F.explode("rare").alias("r")).select("row_no", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    c = F.coalesce("c", F.lit(0))
    looked = rare.join(words, "word", "left").groupBy("row_no").agg(F.sum(F.col("times") * F.log10(c + 0.1)).alias("rare_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    base = F.col("top_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(model.n + 0.1 * (model.v + 1)))
    out = done.drop("rare", "stretches").join(looked, "row_no", "left").join(_gains(done), "row_no", "left").withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0)))
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes"))
    return out.select(*[F.col(f"`{n}`") for n in names], "n_tokens", (F.col("top_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def _gains(done: DataFrame) -> DataFrame:
    """(row_no, gain): what the contexts of the training texts add to log10 of a document, for documents that meet any."""
    # A stretch counts once a document, so that a document can be taken out of the counts again.
    once = done.where("learned_").select(F.explode(F.array_distinct(F.transform("stretches", lambda s: F.struct(s["context"].alias("context"), s["stretch"].alias("stretch"))))).alias("s"))
    pairs = once.groupBy("s.context", "s.stretch").agg(F.count(F.lit(1)).alias("n"))
    table = pairs.groupBy("context").agg(F.max(F.struct("n", "stretch")).alias("best"), F.sum("n").alias("all"))
    placed = done.select("row_no", "learned_", F.posexplode("stretches").alias("place", "s")).select("row_no", "learned_", "place", F.col("s.context").alias("context"), F.col("s.stretch").alias("stretch"), F.col("s.log").alias("log"))
    hit, own = F.col("stretch") == F.col("best.stretch"), F.col("learned_").cast("int")
    n, others = F.col("best.n") - F.when(hit, own).otherwise(0), F.col("all") - own
    cell = (F.least(n, F.lit(SUPPORTS)) - 1) * SHARES + F.least(F.floor(SHARES * n / others), F.lit(SHARES - 1))
    met = placed.join(table, "context").where(n > 0).select("row_no", "learned_", F.struct("place", cell.cast("int").alias("cell"), hit.alias("hit"), "log").alias("d"))
    told = written(met.groupBy("row_no").agg(F.first("learned_").alias("learned_"), F.array_sort(F.collect_list("d")).alias("decisions")), "decisions")
    seen = told.where("learned_").select(F.explode("decisions").alias("d")).groupBy("d.cell").agg(F.sum(F.col("d.hit").cast("long")).alias("hits"), F.count(F.lit(1)).alias("n")).collect()  # at most SUPPORTS * SHARES rows
    of_cell = {r["cell"]: (r["hits"] + MAP_PRIOR * (r["cell"] % SHARES + 0.5) / SHARES) / (r["n"] + MAP_PRIOR) for r in seen}
    prior = F.array(*[F.lit(float(of_cell.get(k, (k % SHARES + 0.5) / SHARES))) for k in range(SUPPORTS * SHARES)])

    def decided(acc, d):
        p = F.least(F.greatest((acc["hits"] + MAP_RATE * F.get(prior, d["cell"])) / (acc["n"] + MAP_RATE), F.lit(1e-4)), F.lit(1 - 1e-4))
        gain = F.when(d["hit"], F.log10(p + (1 - p) * F.pow(F.lit(10.0), d["log"])) - d["log"]).otherwise(F.log10(1 - p))
        return F.struct((acc["hits"] + d["hit"].cast("double")).alias("hits"), (acc["n"] + 1).alias("n"), (acc["gain"] + gain).alias("gain"))

    start = F.struct(F.lit(0.0).alias("hits"), F.lit(0.0).alias("n"), F.lit(0.0).alias("gain"))
    return told.select("row_no", F.aggregate("decisions", start, decided)["gain"].alias("gain"))
