"""SentencePiece encoding by suffix-array matching, and exact decoding.

The texts of a batch are cut before each run of spaces and around line ends
(no piece holds a space after another character or a line end, so no piece
crosses such a cut; the loader checks it). The distinct stretches are concatenated and indexed by a suffix
array, sorted as deep as one 64-bit key reaches. Every piece is looked up in it by binary
search: its occurrences are one range (a piece longer than
the key is compared further within its range). The ranges, sorted by position, are the
edges of a lattice, which is relaxed from left to right.

The vocabulary is of the BPE kind: its encoding is the result of merges, not
the cheapest path. Each prefix of a BPE encoding is the encoding of that
prefix, so each position has exactly one last token; an edge is relaxed if its
piece may follow the last token at its start, that is if merging the two
pieces' joint text gives just these two. This equals the merges exactly.

Characters that are no piece become byte pieces. A literal U+2581 (the mark
for a space in the vocabulary file) is encoded as bytes, so that every text
decodes to itself.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters in one suffix array; stretches and pairs remembered by a worker; the longest stretch relaxed in step with others.
INDEXED, REMEMBERED, TOGETHER = 1 << 18, 150_000, 48
#: Bytes of stretches and their ids that a worker remembers in each of two generations.
REMEMBERED_BYTES = 8 << 20
_STRETCH, _LINE_STRETCH = re.compile(r" *[^ ]+| +"), re.compile(r" *[^ \n]+| +|\n")


class Vocabulary:
    """Pieces, scores and byte pieces of a model file. Small: it travels with the task."""

    def __init__(self, path: str = DEFAULT_MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [0] * 256
        self.data: list[bytes] = []
        for k in range(model.vocab_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(piece[3:5], 16)] = k
                self.data.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.data.append(b"")
            else:
                text = piece.replace("▁", " ")
                if re.search("[^ ] ", text):
                    raise ValueError("a piece holds a space after another character")
                self.id_of[text], self.score[text] = k, model.get_score(k)
                self.data.append(text.encode())
        whole = {p for p in self.id_of if self.merged(p) == [p]}
        #: Pieces that are their own encoding; no other can be in one.
        self.pieces = sorted(whole, key=lambda p: self.id_of[p])
        self.text_of = {self.id_of[p]: p for p in self.pieces}
        #: Where no piece holds a line end, nothing merges across one.
        self.stretch = _STRETCH if any("\n" in p for p in self.id_of) else _LINE_STRETCH
        self.single = {p for p in self.pieces if len(p) == 1}

    def merged(self, text: str) -> list[str]:
        """The BPE encoding of a short text by merging the best pair, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.follows: dict[tuple[int, int], bool] = {}
        self.tags, self.answers = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.whole = frozenset(vocabulary.pieces)
        self.sizes = np.array([len(p) for p in vocabulary.pieces])
        self.longest = int(self.sizes.max())
        if self.longest > 63 or max(vocabulary.id_of.values()) >= 1 << 18:
            raise ValueError("pieces of up to 63 characters and ids under 2^18 fit the packed edges")
        self.ids = np.array([vocabulary.id_of[p] for p in vocabulary.pieces])
        self.spelled = np.zeros((len(self.sizes), self.longest), np.int64)
        for row, piece in zip(self.spelled, vocabulary.pieces):
            row[: len(piece)] = [ord(c) for c in piece]

    # The lattice -----------------------------------------------------------------

    def edges(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece id) of every occurrence of every piece, by start, then end; 0 separates stretches."""
        present = np.zeros(int(symbols.max()) + 2, bool)
        present[symbols] = True
        code_of = np.cumsum(present).astype(np.uint64)  # 1, 2, ... in the order of the code points
        width = int(code_of[-1]).bit_length()
        depth = min(64 // width, self.longest)
        codes = np.concatenate([code_of[symbols], np.zeros(self.longest, np.uint64)])
        n = len(symbols)
        key = np.zeros(n, np.uint64)
        for c in range(depth):
            key = key << np.uint64(width) | codes[c : c + n]
        order = np.argsort(key)
        key = key[order]
        # The pieces as keys: those with a character that is not here have no occurrence.
        spelled, sizes = self.spelled, self.sizes
        here = np.where(spelled < len(present), present[np.minimum(spelled, len(present) - 1)], False) | (spelled == 0)
        some = np.flatnonzero(here.all(1))
        spelled, sizes = code_of[np.minimum(spelled[some], len(present) - 1)] * (spelled[some] > 0), sizes[some]
        low, rest = np.zeros(len(some), np.uint64), np.maximum(depth - sizes, 0).astype(np.uint64) * np.uint64(width)
        for c in range(depth):
            low = low << np.uint64(width) | spelled[:, c]
        first = np.searchsorted(key, low, "left")
        last = np.searchsorted(key, low | (np.uint64(1) << rest) - np.uint64(1), "right")
        count = last - first
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start = order[np.repeat(first, count) + inside]
        size, ids = np.repeat(sizes, count), np.repeat(self.ids[some], count)
        if depth < self.longest:  # beyond the key's depth a long piece is compared within its range
            deep = np.flatnonzero(size > depth)
            which = np.repeat(np.arange(len(some)), count)[deep]
            equal = np.ones(len(deep), bool)
            for c in range(depth, self.longest):
                equal &= (spelled[which, c] == 0) | (codes[start[deep] + c] == spelled[which, c])
            keep = np.ones(len(start), bool)
            keep[deep[~equal]] = False
            start, size, ids = start[keep], size[keep], ids[keep]
        packed = np.sort((start << 24) | (size << 18) | ids)
        start = (packed >> 24).astype(np.int32)
        return start, start + (packed >> 18 & 63).astype(np.int32), (packed & (1 << 18) - 1).astype(np.int32)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the joint text of pieces a and b is encoded as just a and b."""
        found = self.follows.get((a, b))
        if found is None:
            if len(self.follows) > 4 * REMEMBERED:
                self.follows.clear()
            x, y = self.v.text_of[a], self.v.text_of[b]
            found = self.follows[a, b] = (x + y) not in self.whole and self.v.merged(x + y) == [x, y]
        return found

    def all_may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """may_follow for arrays, through a table that keeps the last answer for each place."""
        code = a.astype(np.int64) << 18 | b
        place = (code * np.int64(0x2545F4914F6CDD1D)) >> 43 & (len(self.tags) - 1)
        miss = self.tags[place] != code
        if miss.any():
            fresh, first = np.unique(code[miss], return_index=True)
            answers = np.array([self.may_follow(c >> 18, c & (1 << 18) - 1) for c in fresh.tolist()])
            out = self.answers[place]
            out[miss] = answers[np.searchsorted(fresh, code[miss])]
            at = place[miss][first]
            self.tags[at], self.answers[at] = fresh, answers
            clash = self.tags[at] != fresh  # of two new pairs in one place the last stays
            self.answers[at[~clash]] = answers[~clash]
            return out
        return self.answers[place]

    def learn(self, stretches: list[str]) -> None:
        """Encode these distinct stretches: plain ones at once, those with other characters or very long one by one."""
        single = self.v.single
        plain = [s for s in stretches if len(s) <= TOGETHER and single.issuperset(s)]
        other = [s for s in stretches if len(s) > TOGETHER or not single.issuperset(s)]
        if plain:
            self.learn_together(plain)
        if other:
            self.learn_each(other)

    def learn_together(self, stretches: list[str]) -> None:
        """Relax the edges of all stretches in step: first those at their first place, then at their second, ..."""
        symbols = np.frombuffer("\0".join(stretches).encode("utf-32-le"), np.uint32)
        start, end, piece = self.edges(symbols)
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        begins = np.cumsum(sizes + 1) - sizes - 1
        offset = np.arange(len(symbols)) - np.repeat(begins, np.minimum(sizes + 1, len(symbols) - begins))
        step = offset[start].astype(np.uint8)
        by_step = np.argsort(step, kind="stable")
        start, end, piece = start[by_step], end[by_step], piece[by_step]
        bounds = np.searchsorted(step[by_step], np.arange(int(sizes.max()) + 1))
        last, back = np.zeros(len(symbols) + 1, np.int32), np.zeros(len(symbols) + 1, np.int32)
        for k, (lo, hi) in enumerate(zip(bounds, [*bounds[1:], len(start)])):
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            if k:
                ok = self.all_may_follow(last[s], p)
                s, e, p = s[ok], e[ok], p[ok]
            last[e], back[e] = p, s
        who, at, found = np.arange(len(stretches)), begins + sizes, []
        while len(who):  # walk back from all ends
            found.append((who, last[at]))
            at = back[at]
            going = at > begins[who]
            who, at = who[going], at[going]
        owner = np.concatenate([w for w, _ in found])
        turn = np.repeat(np.arange(len(found)), [len(w) for w, _ in found])
        ids = np.concatenate([t for _, t in found])[np.lexsort((-turn, owner))].astype(np.int32).tobytes()
        stops = (4 * np.cumsum(np.bincount(owner, minlength=len(stretches)))).tolist()
        self.known.update((s, ids[i:j]) for s, i, j in zip(stretches, [0, *stops], stops))

    def learn_each(self, stretches: list[str]) -> None:
        text = "\0".join(s.replace("\0", "￾") for s in stretches)
        symbols = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        start, end, piece = (x.tolist() for x in self.edges(symbols))
        begins = [0, *accumulate(len(s) + 1 for s in stretches)]
        last, back = [-1] * (len(symbols) + 1), [-1] * (len(symbols) + 1)
        e, n_edges, follows = 0, len(start), self.follows
        single = self.v.id_of
        for k, stretch in enumerate(stretches):
            stop = begins[k] + len(stretch)
            for at in range(begins[k], stop):
                before = last[at]
                fresh = at == begins[k] or before == -2  # nothing merges with a byte piece
                if stretch[at - begins[k]] not in single:  # a character that is no piece: its bytes
                    last[at + 1], back[at + 1] = -2, at
                while e < n_edges and start[e] == at:
                    p = piece[e]
                    if fresh or follows.get((before, p)) or ((before, p) not in follows and self.may_follow(before, p)):
                        last[end[e]], back[end[e]] = p, at
                    e += 1
            ids: list[int] = []
            at = stop
            while at > begins[k]:
                if last[at] == -2:
                    ids += [self.v.byte_id[b] for b in reversed(stretch[at - begins[k] - 1].encode("utf-8", "surrogatepass"))]
                else:
                    ids.append(last[at])
                at = back[at]
            self.known[stretch] = code = np.array(ids[::-1], np.int32).tobytes()
            self.held += 4 * len(stretch) + len(code)

    # Texts -----------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as 32-bit integers; an empty text has none."""
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:  # two generations: what was used lately stays
            self.older, self.known, self.held = self.known, {}, 0
        known, cut = self.known, [self.v.stretch.findall(" " + t) if t else [] for t in texts]
        new = {s for parts in cut for s in parts if s not in known}
        batch, held = [], 0
        for s in new:
            if s in self.older:
                known[s] = self.older[s]
                self.held += 4 * len(s) + len(known[s])
                continue
            batch.append(s)
            held += len(s) + 1
            if held > INDEXED:
                self.learn(batch)
                batch, held = [], 0
        if batch:
            self.learn(batch)
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]

    def decode(self, ids) -> str:
        """The text of a list of ids: one space at the front is the encoder's own."""
        data = b"".join(map(self.v.data.__getitem__, ids)).decode("utf-8", "replace")
        return data[1:] if data.startswith(" ") else data


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker and vocabulary, so that what it remembers serves later tasks."""
    key = hash((len(vocabulary.data), tuple(vocabulary.data[:: max(1, len(vocabulary.data) // 500)])))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def encode(docs: DataFrame, keys: list[Column], text: Column, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """The key columns, n_tokens, token_ids (array<int>) and round_trip: whether decoding gives the text back.

    A null text has null ids, null n_tokens and a null round_trip; an empty
    one has none; repeated rows are rows of their own; an empty table gives
    no rows; other columns are not read.
    """
    vocabulary = Vocabulary(model_path)
    rows = small_batches(docs).select(*keys, text.alias("text_"))
    names = rows.columns[:-1]

    def coded(batches):
        encoder = _encoder(vocabulary)
        for batch in sliced(batches):
            texts = batch.column(len(names)).to_pylist()
            codes = encoder.encode([t or "" for t in texts])
            sizes = np.array([len(c) // 4 for c in codes], np.int32)
            missing = np.array([t is None for t in texts], bool)
            same = [encoder.decode(np.frombuffer(c, np.int32).tolist()) == (t or "") for c, t in zip(codes, texts)]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            values = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(codes))])
            lists = pa.ListArray.from_arrays(offsets, values, mask=pa.array(missing))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(sizes.astype(np.int64), mask=missing), lists, pa.array(same, mask=missing)], [*names, "n_tokens", "token_ids", "round_trip"])

    return rows.mapInArrow(coded, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_tokens long, token_ids array<int>, round_trip boolean")


def decode(rows: DataFrame, keys: list[Column], ids: Column, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """The key columns and ``text``; null ids give a null text, ids outside the vocabulary fail."""
    vocabulary = Vocabulary(model_path)
    rows = rows.select(*keys, ids.alias("ids_"))
    names = rows.columns[:-1]

    def spelled(batches):
        encoder = _encoder(vocabulary)
        for batch in sliced(batches):
            texts = [None if x is None else encoder.decode(x) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(texts, pa.string())], [*names, "text"])

    return rows.mapInArrow(spelled, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", text string")
