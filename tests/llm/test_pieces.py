from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece
from panelwright.llm import pieces, queries
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


PARTS = ["a", "b", " ", "  ", "the", "é", "\n", "\t", "0", "\0", "▁", "日本", "🎉", "ing", "    ", ".", "...", "http://", "//", "=", "--", "===", "Ж"]
ODD = [" ", "  ", "", "a" * 5000, " " * 3000, "ab" * 3000, "日" * 500, "\0" * 50, "▁▁ ▁a", "x" * 47 + " " + "x" * 48 + " " + "x" * 49]


def test_same_ids_as_the_merges_and_exact_decoding(vocabulary, library):
    rng, encoder = random.Random(1), pieces.Encoder(vocabulary)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(3000)] + ODD
    for text, code in zip(texts, encoder.encode(texts)):
        ids = np.frombuffer(code, np.int32).tolist()
        assert encoder.decode(ids) == text
        if "▁" not in text:
            assert ids == library.encode(text)


def test_small_indexes_and_forgetting_give_the_same(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "INDEXED", 50)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    rng, encoder = random.Random(2), pieces.Encoder(vocabulary)
    for _ in range(20):
        texts = ["".join(rng.choice(PARTS[:10]) for _ in range(40)).replace("▁", "") for _ in range(10)]
        assert [np.frombuffer(c, np.int32).tolist() for c in encoder.encode(texts)] == [library.encode(t) for t in texts]


def test_edges_are_all_occurrences(vocabulary):
    encoder, text = pieces.Encoder(vocabulary), " the thing in the\0 thing 日"
    start, end, piece = encoder.edges(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    want = sorted((i, i + len(p), vocabulary.id_of[p]) for p in vocabulary.pieces for i in range(len(text)) if text.startswith(p, i))
    assert sorted(zip(start.tolist(), end.tolist(), piece.tolist())) == want


def test_rows(spark, library):
    docs = spark.createDataFrame([(1, "hello  world", "x"), (2, None, "x"), (2, "", "x"), (None, "tab\t日", "x"), (1, "hello  world", "x")], "doc_id long, text string, token_ids string")
    coded = pieces.encode(docs, [F.col("doc_id")], F.col("text"))
    rows = coded.collect()
    assert [(r.doc_id, r.n_tokens, r.round_trip) for r in rows] == [(1, len(library.encode("hello  world")), True), (2, None, None), (2, 0, True), (None, len(library.encode("tab\t日")), True), (1, len(library.encode("hello  world")), True)]
    assert [r.token_ids for r in rows] == [library.encode("hello  world"), None, [], library.encode("tab\t日"), library.encode("hello  world")]
    assert [r.text for r in pieces.decode(coded, [F.col("doc_id")], F.col("token_ids")).collect()] == ["hello  world", None, "", "tab\t日", "hello  world"]
    assert pieces.encode(docs.limit(0), [F.col("doc_id")], F.col("text")).count() == 0


def test_whole_table(spark, library):
    got = {r.doc_id: r for r in queries.op4_pieces(spark, "/root/testdata/sf0.001").collect()}
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert got[row.doc_id].token_ids == library.encode(row.text) and got[row.doc_id].round_trip
