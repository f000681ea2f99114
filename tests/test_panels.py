"""Frames, identities and records beyond what DuckDB states: allocation, signatures, refusals, odd rows."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from panelwright.functions import eligibility, html, identity, stats, years
from panelwright.operators import consolidated, frames, resolve, runs, sampling, similarity
from panelwright.sources import readers
from pyspark.sql import functions as F


def test_signatures_equal_the_plain_permutations(spark):
    made = identity.MinHash("seed")
    p = identity.MODULUS
    keyed = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8, key=made.key).digest(), "big")
    rng = random.Random(2)
    for n in (1, 3, 5000):
        items = [f"item {rng.random()}" for _ in range(n)]
        hashes = [keyed(s.encode()) for s in items]
        want = [min(((keyed(f"a:{i}".encode()) % (p - 1) + 1) * h + keyed(f"b:{i}".encode()) % p) % p for h in hashes) for i in (0, 1, 64, 127)]
        got = made.signature(items)
        assert len(got) == identity.PERMUTATIONS and [got[i] for i in (0, 1, 64, 127)] == want
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["b", "a"])], "key long, items array<string>")
    rows = {r.key: r for r in identity.signatures(sets, "seed").collect()}
    assert rows[2].signature is None and rows[3].digest is None and rows[1].digest == rows[4].digest and len(rows[1].digest) == 32


def test_group_ids_name_their_members(spark):
    rows = spark.createDataFrame([("i", 1, "b"), ("i", 1, "a"), ("i", 2, "a"), ("j", 1, "a"), ("j", 1, "b")], "scope string, `group` int, member string")
    got = {(r.scope, r.group): r.group_id for r in identity.group_ids(rows, "v").collect()}
    assert got["i", 1] == "sg-" + hashlib.blake2b(json.dumps(["v", "i", ["a", "b"]], separators=(",", ":")).encode(), digest_size=10).hexdigest()
    assert len(set(got.values())) == 3


def test_allocation_keeps_floors_and_caps(spark):
    rng = random.Random(3)
    cells = [(f"s{s}", f"c{s}{c}", level, rng.randint(0, 30)) for s in range(4) for c in range(6) for level in ("local", "state", "nation")]
    df = spark.createDataFrame(cells, "stratum string, country string, level string, n long")
    specs = spark.createDataFrame([(f"s{s}", 60, 14) for s in range(4)], "stratum string, size long, cap long")
    floors = spark.createDataFrame([("s0", "nation", 4), ("s1", "state", 0)], "stratum string, level string, floor long")
    got = frames.allocate(df, specs, floors).collect()
    held = {(s, c, level): n for s, c, level, n in cells}
    for s in range(4):
        own = [r for r in got if r.stratum == f"s{s}"]
        assert sum(r["take"] for r in own) == 60 and all(0 < r["take"] <= held[r.stratum, r.country, r.level] for r in own)
        assert all(sum(r["take"] for r in own if r.country == c) <= 14 for c in {r.country for r in own})
    assert sum(r["take"] for r in got if r.stratum == "s0" and r.level == "nation") == 4
    assert not any(r.stratum == "s1" and r.level == "state" for r in got)
    with pytest.raises(Exception, match="do not make"):
        frames.allocate(df, specs.withColumn("size", F.lit(100_000)), floors).collect()
    with pytest.raises(frames.RepeatedClaim):
        frames.classify_cells(df.withColumn("uid", F.lit(1)), df.select(F.lit(1).alias("uid")), spark.createDataFrame([("a", "c00"), ("b", "c00")], "stratum string, country string"))


def test_shares_fill_up_and_spill_over():
    assert frames._shared({"a": 2, "b": 50, "c": 50}, {"a": 1000, "b": 30, "c": 10}, 10) == {"a": 2, "b": 6, "c": 2}
    assert frames._shared({"a": 1, "b": 1}, {"a": 1, "b": 1}, 2) == {"a": 1, "b": 1} and frames._shared({}, {}, 0) == {}
    rng = random.Random(4)
    for _ in range(200):
        room = {k: rng.randint(0, 9) for k in "abcdef"}
        total = rng.randint(0, sum(room.values()))
        out = frames._shared(room, {k: room[k] + rng.randint(0, 5) for k in room}, total)
        assert sum(out.values()) == total and all(0 <= out[k] <= room[k] for k in room)


def test_quotas_take_the_same_rows_whichever_way(spark, monkeypatch):
    rows = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("s"))
    quotas = spark.createDataFrame([("hot", 5), ("cold", 3), ("none", 2)], "s string, n int")
    got = {r.k for r in sampling.take_quotas(rows, quotas, "s", "k", 7).collect()}
    every = rows.withColumn("u", sampling.uniform(7, "k")).collect()
    want = {r.k for s, n in (("hot", 5), ("cold", 3)) for r in sorted((r for r in every if r.s == s), key=lambda r: (r.u, r.k))[:n]}
    assert got == want
    assert sampling.take_quotas(rows, spark.createDataFrame([("cold", 10_000)], "s string, n int"), "s", "k", 7).count() == 800


def test_draws_and_subsets(spark):
    frame = spark.range(500).select(F.col("id").alias("uid"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("country"))
    got = frames.subset(frame, 20, "uid", 3).collect()
    assert sorted(r.draw_pos for r in got) == list(range(1, 21)) and {r.uid for r in got} == {r.uid for r in frames.subset(frame.repartition(7), 20, "uid", 3).collect()}
    with pytest.raises(frames.ShortDraw):
        frames.subset(frame, 501, "uid", 3)
    with pytest.raises(frames.ShortDraw):
        frames.subset_by_stratum(frame, spark.createDataFrame([("s", 9999)], "stratum string, size int"), spark.createDataFrame([("s", "c1")], "stratum string, country string"), "uid", 3)


def test_closure_is_as_deep_as_the_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 50)], "child int, parent int")
    got = {(r.node, r.ancestor): r.depth for r in resolve.parent_chain(edges, spark.createDataFrame([(0,), (50,), (90,)], "node int")).collect()}
    assert got == {**{(0, k): k for k in range(41)}, (50, 50): 0, (50, 51): 1, (90, 90): 0}


def test_mcnemar_far_beyond_thirty_pairs(spark):
    from math import comb

    for gains, losses in ((94, 5), (0, 0), (3, 3), (40, 38), (700, 500)):
        n, k = gains + losses, min(gains, losses)
        want = min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)
        got = spark.range(1).select(stats.mcnemar_exact(F.lit(gains), F.lit(losses))).first()[0]
        assert got == pytest.approx(want, rel=1e-9)


def test_only_the_first_good_base_counts():
    link = '<a href="x">x</a>'
    base = lambda *hrefs: html.parse("".join(f'<base href="{h}">' for h in hrefs) + link, "https://h.org/d/p")[2][0][0]
    assert base() == "https://h.org/d/x" and base("/q/") == "https://h.org/q/x" and base("/q/", "/r/") == "https://h.org/q/x"
    assert base("javascript:void(0)", "/r/") == "https://h.org/d/x" and base("data:text/html,") == "https://h.org/d/x"


def test_mail_links(spark):
    page = '<a href="mailto:A@B.org?subject=x">m</a><a href="MAILTO:c%40d.com,a@b.org">m</a><a href="https://x.org/a@b">n</a><a href="mailto:none">n</a>'
    rows = html.email_links(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).collect()
    assert {r.key: r.emails for r in rows} == {1: ["a@b.org", "c@d.com"], 2: []}


def test_markers_far_from_the_year_count():
    gap = " " * 90
    assert any(h[3] == "fiscal_one" for h in years.mine_years(f"Haushaltsjahr{gap}2019", 2025))
    assert any(h[3] == "fiscal_one" for h in years.mine_years(f"2019{gap}fiscal year", 2025))
    assert [years.han_number(x) for x in ("元", "12", "二〇", "十", "二十", "百〇三", "百十", "三百二十一")] == [1, 12, 20, 10, 20, 103, 110, 321]
    assert (years.two_digit_year(49, 2024), years.two_digit_year(48, 2024), years.two_digit_year(99, 2024)) == (1949, 2048, 1999)
    assert years.plain_digits("٢٠٢٤ ๒๕๖๗ a") == "2024 2567 a"


def test_keyword_patterns_keep_to_word_edges(spark):
    holds = lambda text, words: spark.range(1).select(consolidated.holds(F.lit(text), words)).first()[0]
    assert holds("Uses LLMs\n daily", consolidated.GENERATIVE) and not holds("Wellman of Alberta", consolidated.GENERATIVE)
    assert holds("has allocated $5M", consolidated.FIRM) and holds("Are   exploring it", consolidated.HEDGED) and not holds("unanticipatedly", consolidated.HEDGED)


def test_documents_that_parse_to_nulls_are_loaded(spark):
    files = spark.createDataFrame([("a", '{"id": null}'), ("b", "{"), ("c", None), ("d", '{"id": 3}'), ("e", "")], "key string, body string")
    got = {r.key: (r.status, r.doc.id if r.doc else None) for r in consolidated.parsed_documents(files, "id long").collect()}
    assert (got["a"], got["b"][0], got["c"][0], got["d"]) == (("loaded", None), "unreadable", "missing", ("loaded", 3)) and got["e"][0] == "unreadable"


def test_refusals(spark):
    with pytest.raises(runs.WrongLayout):
        runs.require_layout(spark.createDataFrame([("r", 1), ("s", None)], "run_id string, layout_version int"), 1).count()
    with pytest.raises(eligibility.NotRostered):
        eligibility.require_rostered(spark.createDataFrame([("xx",)], "language string"), spark.createDataFrame([("en",)], "language string"))
    with pytest.raises(RuntimeError):
        runs.waves(spark.createDataFrame([(0,)], "n int"), lambda s: s.selectExpr("n + 1 AS n"), 3)


def test_located_quotes(spark):
    rows = [("b c", "a b c d", (2, 5)), ("B  c", "a b\n c d", (2, 6)), ("x.y*", "q X.Y* z", (2, 6)), ("zz", "a", None), ("", "a", None), (" ", "ab", None), ("É", "l'été", (2, 3))]
    df = spark.createDataFrame([(q, t) for q, t, _ in rows], "q string, t string").select(runs.located(F.col("q"), F.col("t")).alias("s"))
    assert [(r.s.start, r.s.end) if r.s else None for r in df.collect()] == [w for _, _, w in rows]


def test_groups_by_pivots_equal_those_by_pairs(spark):
    rng = random.Random(5)
    docs = []
    for k in range(30):
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "edit"
            docs.append((len(docs), " ".join(copy), k % 3))
    df = spark.createDataFrame(docs, "key long, text string, s int")
    sets = {k: (frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)), s) for k, t, s in docs for w in [t.split()]}
    for scope in (None, "s"):
        root = {k: k for k in sets}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a in sets:
            for b in sets:
                (x, sx), (y, sy) = sets[a], sets[b]
                if a < b and x and y and (scope is None or sx == sy) and 5 * len(x & y) >= 4 * len(x | y):
                    u, v = find(a), find(b)
                    root[max(u, v)] = min(u, v)
        got = {r.key: r.group_key for r in similarity.near_duplicate_groups(df, scope).collect()}
        assert got == {k: find(k) for k in sets}


def test_body_routes(spark):
    import io
    import zipfile

    def packed(name):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, "<x/>")
        return out.getvalue()

    rows = [
        (b"%PDF-1.4", "text/html", "u", "pdf"), (b"\n junk %PDF-1.7", "", "u", "pdf"), (b"<p>%PDF-1.4", "", "u", "html"), (packed("word/document.xml"), "text/html", "u", "docx"),
        (packed("xl/workbook.xml"), "application/officedocument", "a.docx", "html"), (b"", "application/PDF", "u", "pdf"), (b"x" * 1020 + b"%PDF-", "", "u", "html"), (None, None, "A.PDF", "pdf"), (None, None, None, "html"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "content binary, kind string, url string")
    got = [r[0] for r in df.select(readers.kind_of(F.col("content"), F.col("kind"), F.col("url"))).collect()]
    assert got == [r[3] for r in rows]
