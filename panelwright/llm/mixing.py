"""Logistic mixing of hashed-context bit predictors for the spelling of words.

A word is its UTF-8 bytes and a terminating space; each byte is a few binary
decisions, along a Huffman code so that common bytes take few. For each
decision five predictors look up a hashed context: the
last 1, 2, 3 and 5 bytes of the word, and the whole word so far. A slot of a
predictor's table holds how often the decision went each way, as a logit with
a confidence class. The logits are mixed with weights chosen by a gate (the
confidence of the longest context and of the middle one); the result is
refined by an adaptive map from (decision, mixed logit) to probability.

Tables have a fixed number of slots, so a model has a fixed size (SLOTS two-byte
entries); the counts in them come from all training words.
"""

from __future__ import annotations

import heapq

import numpy as np

#: log2 of each predictor's slots; the context's length in bytes, 0 for the whole word so far.
BITS, ORDERS = (14, 17, 20, 21, 22), (1, 2, 3, 5, 0)
SLOTS = sum(1 << b for b in BITS)
K, MIDDLE, LONGEST = len(BITS), 2, 4
CLASSES, GATES = 8, 64
#: Weights before learning: mostly the longest context.
START = (0.0, 0.0, 0.1, 0.2, 0.7)
LOGIT_MAX, LOGIT_STEPS = 12.0, 8192
MAP_STEPS, MAP_MAX, MAP_SHARE = 24, 9.0, 0.5
#: Decisions in one vectorised pass.
PASS = 1 << 18

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_NODE = np.uint64(0xD6E8FEB86659FD93)
_POWER = np.uint64(0xB5297A4D3F84D5B5)
_CLASS_LIMITS = np.array([1, 2, 3, 6, 16, 64, 1024])


def packed(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Table entries for counts: 13 bits of logit, 3 bits of confidence."""
    n = n0 + n1
    logit = np.clip(np.log((n1 + 0.02 + 0.2 * (n < 3)) / (n0 + 0.02 + 0.2 * (n < 3))), -LOGIT_MAX, LOGIT_MAX)
    level = np.rint((logit + LOGIT_MAX) * ((LOGIT_STEPS - 1) / (2 * LOGIT_MAX))).astype(np.uint16)
    return level << np.uint16(3) | np.searchsorted(_CLASS_LIMITS, n, side="right").astype(np.uint16)


EMPTY = int(packed(np.zeros(1), np.zeros(1))[0])
_LOGITS = (np.arange(LOGIT_STEPS) * (2 * LOGIT_MAX / (LOGIT_STEPS - 1)) - LOGIT_MAX).astype(np.float32)


class Code:
    """A prefix code of the 256 bytes: for each byte its path as (inner node, bit) pairs."""

    def __init__(self, times: np.ndarray):
        heap = [(float(t) + 1e-3, b, b) for b, t in enumerate(times)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:  # node 256 + k joins children[k]
            (x, _, left), (y, at, right) = heapq.heappop(heap), heapq.heappop(heap)
            children.append((left, right))
            heapq.heappush(heap, (x + y, at, 255 + len(children)))
        paths: dict[int, list[tuple[int, int]]] = {255 + len(children): []}
        for k in range(len(children) - 1, -1, -1):
            for bit, child in enumerate(children[k]):
                paths[child] = [*paths[256 + k], (k, bit)]
        self.sizes = np.array([len(paths[b]) for b in range(256)])
        self.nodes, self.bits = np.zeros((2, 256, int(self.sizes.max())), np.int64)
        for b in range(256):
            self.nodes[b, : self.sizes[b]] = [n for n, _ in paths[b]]
            self.bits[b, : self.sizes[b]] = [bit for _, bit in paths[b]]

    @classmethod
    def of_words(cls, words: list[bytes], times: np.ndarray) -> Code:
        data = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return cls(np.bincount(data, np.repeat(times, sizes), 256))


class Decisions:
    """All decisions of some words: node (0 to 254), bit, word number, byte's place in the word, and the slot in each predictor's table."""

    def __init__(self, words: list[bytes], code: Code):
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begins = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(begins, sizes)
        powers = np.multiply.accumulate(np.full(int(sizes.max()), _POWER))
        total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place])
        before = np.concatenate([np.zeros(1, np.uint64), total[:-1]])
        steps = code.sizes[data]
        step = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
        byte = np.repeat(data, steps)
        self.node, self.bit = code.nodes[byte, step], code.bits[byte, step]
        self.word, self.place = np.repeat(np.repeat(np.arange(len(words)), sizes), steps), np.repeat(place, steps)
        mixed = (self.node.astype(np.uint64) + np.uint64(1)) * _NODE
        self.slots = []
        for order, bits in zip(ORDERS, BITS):
            if order == 0:
                context = before - np.repeat(before[begins], sizes) + place.astype(np.uint64)
            else:
                context = np.zeros(len(data), np.uint64)
                for back in range(1, order + 1):
                    shifted = np.zeros(len(data), np.uint64)
                    shifted[back:] = data[:-back].astype(np.uint64) + np.uint64(1)
                    context = context << np.uint64(9) | np.where(place >= back, shifted, np.uint64(0))
            context = (context + np.uint64(order)) * _MULTIPLY
            h = (np.repeat(context ^ context >> np.uint64(29), steps) ^ mixed) * _MULTIPLY
            self.slots.append((h >> np.uint64(64 - bits)).astype(np.int64))


def passes(words: list[bytes], code: Code):
    """(first word, Decisions) of runs of words of bounded length; a longer word is a run of its own."""
    start, held = 0, 0
    for k, w in enumerate(words):
        if held and held + 5 * (len(w) + 1) > PASS:
            yield start, Decisions(words[start:k], code)
            start, held = k, 0
        held += 5 * (len(w) + 1)
    if held:
        yield start, Decisions(words[start:], code)


class Counts:
    """How often each slot's decision went each way."""

    def __init__(self, code: Code):
        self.code, self.n = code, [np.zeros((2, 1 << b), np.int64) for b in BITS]

    def add(self, words: list[bytes], times: np.ndarray) -> None:
        for start, d in passes(words, self.code):
            often = times[start : start + int(d.word[-1]) + 1].astype(np.int64)[d.word]
            for n, slots in zip(self.n, d.slots):
                np.add.at(n.reshape(-1), d.bit * n.shape[1] + slots, often)


class Mixer:
    """tables[k]: entries of predictor k; weights[gate, k]; refine[node, step]: probabilities."""

    def __init__(self, code: Code, tables: list[np.ndarray], weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.code, self.tables = code, tables
        self.weights = np.tile(np.array(START, np.float32), (GATES, 1)) if weights is None else weights.astype(np.float32)
        self.refine = refine

    def inputs(self, entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        logits = np.stack([_LOGITS[e >> 3] for e in entries], 1)
        return logits, (entries[LONGEST] & 7).astype(np.int64) * CLASSES + (entries[MIDDLE] & 7)

    def mixed(self, logits: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", logits, self.weights[gate]), -LOGIT_MAX, LOGIT_MAX)

    def refined(self, node: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Probability of a 1: the mix and the adaptive map, shared."""
        p = 1 / (1 + np.exp(-z))
        if self.refine is not None:
            at = np.clip((z + MAP_MAX) * (MAP_STEPS / (2 * MAP_MAX)), 0, MAP_STEPS - 1e-3)
            low = at.astype(np.int64)
            share = at - low
            p = (1 - MAP_SHARE) * p + MAP_SHARE * ((1 - share) * self.refine[node, low] + share * self.refine[node, low + 1])
        return np.clip(p, 2e-6, 1 - 2e-6)

    def log10(self, words: list[bytes], start_bytes: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word with its terminator, and of its first bytes (the terminator may be one)."""
        out, begin = np.zeros(len(words)), np.zeros(len(words))
        for start, d in passes(words, self.code):
            logits, gate = self.inputs([t[s] for t, s in zip(self.tables, d.slots)])
            p = self.refined(d.node, self.mixed(logits, gate)).astype(np.float64)
            cost = np.log10(np.where(d.bit, p, 1 - p))
            n = int(d.word[-1]) + 1
            out[start : start + n] = np.bincount(d.word, cost, n)
            first = d.place < start_bytes
            begin[start : start + n] = np.bincount(d.word[first], cost[first], n)
        return out, begin

    # Learning: tables are pairs (without one 0, without one 1), so that no word predicts itself.

    def left_out(self, d: Decisions) -> list[np.ndarray]:
        return [t[d.bit, s] for t, s in zip(self.tables, d.slots)]

    def learn(self, words: list[bytes], times: np.ndarray, rate: float = 0.05, batch: int = 4096) -> np.ndarray:
        """Online gradient steps on the coding cost, a batch of decisions at a time; frequent words count by their square root.

        Returns (2, 255, MAP_STEPS + 1) counts of what followed each mixed logit.
        """
        order = np.random.default_rng(len(words)).permutation(len(words))
        words, times = [words[k] for k in order], times[order]
        seen = np.zeros((2, 255 * (MAP_STEPS + 1)))
        for start, d in passes(words, self.code):
            logits, gate = self.inputs(self.left_out(d))
            own = times[start : start + int(d.word[-1]) + 1]
            often = np.sqrt(own)[d.word]
            often = often / often.mean()
            for lo in range(0, len(d.bit), batch):
                x, g, w = logits[lo : lo + batch], gate[lo : lo + batch], often[lo : lo + batch]
                error = (d.bit[lo : lo + batch] - 1 / (1 + np.exp(-self.mixed(x, g)))) * w
                total = np.bincount(g, w, GATES)[:, None] + 20
                step = np.stack([np.bincount(g, error * x[:, k], GATES) for k in range(K)], 1) / total
                self.weights += (rate * step).astype(np.float32)
            z = self.mixed(logits, gate)
            near = np.clip(np.rint((z + MAP_MAX) * (MAP_STEPS / (2 * MAP_MAX))), 0, MAP_STEPS).astype(np.int64)
            both = np.bincount((d.node * (MAP_STEPS + 1) + near) * 2 + d.bit, own.astype(float)[d.word], seen.size)
            seen[0] += both[0::2]
            seen[1] += both[1::2]
        return seen.reshape(2, 255, MAP_STEPS + 1)


def refinement(seen: np.ndarray, prior: float = 30.0) -> np.ndarray:
    """The adaptive map from counts: towards the mixed probability where little was seen."""
    centre = 1 / (1 + np.exp(-(np.arange(MAP_STEPS + 1) * (2 * MAP_MAX / MAP_STEPS) - MAP_MAX)))
    return ((seen[1] + prior * centre) / (seen.sum(0) + prior)).astype(np.float32)
