from __future__ import annotations

import corpus_pipeline as cp
import sentencepiece
from panelwright.llm import decontaminate, pieces, pii, simhash, toxicity
from panelwright.llm.common import held_out
from tests.llm.test_decontaminate import passage
from tests.llm.test_simhash import brute, plain

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_python(spark):
    """Each stage's decision by a per-document loop, near duplicates by all pairs, tokens by the library."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~held_out("doc_id", 3, 1))
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    lexicon = model.lexicon()
    left = {i: r.text for i, r in docs.items() if model.scores(lexicon, [r.text or ""])[0] < 0.7}
    root = brute({i: plain(t) for i, t in sorted(left.items())})
    left = {i: t for i, t in left.items() if root[i] == i}
    bench = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = decontaminate.Items([(k, " ".join(w)) for k, w in enumerate(bench)])
    left = {i: t for i, t in left.items() if not t or all(items.align(k, decontaminate.words_of(t))[0] < decontaminate.COVERAGE for k in range(len(bench)))}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    want = {}
    for i, t in left.items():
        base = pii.base_spans(t or "")
        want[i] = library.encode(pii.redacted(t or "", base + pii.trained().added([t or ""], [base])[0]))
    got = cp.run(spark, SF).collect()
    assert {r.doc_id: r.token_ids for r in got} == want and len(got) == len(want)
    assert all(r.round_trip for r in got)


def test_stages_keep_the_columns_and_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (None, "q w e r t y", None, None, None), (5, "mail a@b.co now", "en", "s", 15), (6, "x " * 60_000, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for stage in (cp.toxicity_filter, cp.near_dedup, cp.decontamination, cp.pii_redaction):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert sorted(r.doc_id or -1 for r in cp.near_dedup(spark, docs, SF).collect()) == [-1, 1, 3, 5, 6]
    redacted = {r.doc_id: r for r in cp.pii_redaction(spark, docs, SF).collect()}
    assert redacted[5].text == "mail [EMAIL] now" and redacted[5].n_chars == 16 and redacted[1].text is None
    assert cp.decontamination(spark, docs, SF).count() == 7 and cp.piece_encoding(spark, docs, SF).count() == 7


def test_decontamination_in_several_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    rng = random.Random(5)
    bench = [(k, " ".join(passage(rng, 20))) for k in range(10)]
    docs = [(i, " ".join(passage(rng, 30)) + (" " + bench[i % 10][1] if i % 4 == 0 else "")) for i in range(80)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == [i for i in range(80) if i % 4]
