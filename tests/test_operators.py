from __future__ import annotations

import gzip
import io
import itertools
import json
import random
import tarfile
import zipfile

import pytest
from panelwright.functions import dates, html, language, quotes, stats, text, urls, years
from panelwright.operators import combine, components, cost, diff, evidence, integrity, packing, repair, resolve, rows, sampling, similarity
from panelwright.sources import readers, writers
from panelwright.streaming import events
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "host", "key"),
    [
        ("https://user:p@WWW.Example.gov:8443/a/B/?q=1#f", "example.gov:8443", "https://user:p@www.example.gov:8443/a/B?q=1"),
        ("HTTP://www.a.b/", "a.b", "http://a.b"),
        ("a.b/c", None, "a.b/c"),
        ("", None, ""),
        ("https://a.b/x/?", "a.b", "https://a.b/x"),
    ],
)
def test_url_identity(spark, url, host, key):
    assert one(spark, urls.site_host(F.lit(url))) == host
    assert one(spark, urls.dedupe_key(F.lit(url))) == key


@pytest.mark.parametrize(
    ("url", "rules"),
    [
        ("https://a.b/register/ai", []),
        ("https://a.b/login.php?x=1", ["login_auth"]),
        ("https://a.b/index.php?q=1", []),
        ("https://a.b/x?search=1&b=2", ["search_results"]),
        ("https://t.co/x", ["url_shortener"]),
        ("https://not.co/x", []),
        ("https://twitter.com/dept", ["social_media_profile"]),
        ("https://twitter.com/dept/status/1", []),
        ("https://www.linkedin.com/company/x", ["social_media_profile"]),
        ("not a url", []),
    ],
)
def test_screen(spark, url, rules):
    assert one(spark, urls.screen(F.lit(url)))["matched_rules"] == rules


@pytest.mark.parametrize(
    ("raw", "partial", "last"),
    [("2024", "2024", "2024-12-31"), ("2024-02", "2024-02", "2024-02-29"), ("2024-02-30", None, None), (" 2024-05-01T10:00:00Z ", "2024-05-01", "2024-05-01"), ("2024-05-01T25:00Z", None, None), ("24", None, None)],
)
def test_partial_dates(spark, raw, partial, last):
    got = dates.normalise_iso(F.lit(raw))
    assert one(spark, got) == partial
    assert one(spark, dates.last_day(got).cast("string")) == last


def test_rates_and_flags(spark):
    assert one(spark, stats.rate(F.lit(1), F.lit(0))) is None
    assert one(spark, stats.flag_low(F.lit(None).cast("double"), 0.5, 0.2)) == "not_run"
    assert [one(spark, stats.flag_low(F.lit(v), 0.5, 0.2)) for v in (0.2, 0.5, 0.51)] == ["fail", "warn", "green"]
    assert [one(spark, stats.flag_high(F.lit(v), 0.5, 0.8)) for v in (0.8, 0.5, 0.49)] == ["fail", "warn", "green"]
    assert one(spark, stats.worst(F.lit("not_run"), F.lit("not_run"))) == "not_run" and one(spark, stats.worst(F.lit("not_run"), F.lit("warn"))) == "warn"
    assert abs(one(spark, stats.mcnemar_exact(F.lit(94), F.lit(5))) - 2.4e-22) < 1e-23


def test_text(spark):
    assert one(spark, text.shingles(text.words(F.lit("a b c d")))) == []
    assert one(spark, text.shingles(text.words(F.lit("A b  c d e")))) == ["a b c d e"]
    assert one(spark, text.letter_share(F.lit("ab1 2"))) == 0.5 and one(spark, text.letter_share(F.lit("  "))) is None
    assert one(spark, text.readability_failure(F.lit("%PDF-1.4 x"))) == "binary_marker:pdf_header"
    assert one(spark, text.readability_failure(F.lit("123 456 %%%"))) == "low_letter_share"
    assert one(spark, text.keywords_near(F.lit("ai " + "x " * 60 + "gpt"), ("ai", "gpt"))) is False
    assert one(spark, text.keywords_near(F.lit("an AI, then gpt."), ("ai", "gpt"))) is True
    assert one(spark, text.keywords_near(F.lit("ai ai ai"), ("ai", "gpt"))) is False
    capped = one(spark, text.capped(F.lit("abcdefghij" * 200), 10))
    assert capped.startswith("abcde\n\n[... 1,990") and capped.endswith("fghij")
    assert one(spark, text.is_near_empty(F.lit(" " * 99))) is True


def test_empty_sets_agree(spark):
    members = spark.createDataFrame([("i", "r1", "a"), ("i", "r2", "b"), ("j", "r1", "a"), ("j", "r2", "a")], "institution string, run string, member string")
    inst = spark.createDataFrame([("i",), ("j",), ("k",)], "institution string")
    assert {r.institution: r.overlap for r in diff.nway_jaccard(members, inst, 2).collect()} == {"i": 0.0, "j": 1.0, "k": 1.0}
    assert {r.institution: r.mean_overlap for r in diff.mean_pairwise_jaccard(members, inst, ["r1", "r2", "r3"]).collect()} == {"i": 0.0, "j": round(1 / 3, 4), "k": 1.0}


def test_similarity_against_all_pairs(spark):
    rng = random.Random(4)
    docs = []
    for k in range(60):
        base = [str(rng.randrange(50)) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "edit"
            docs.append((len(docs), " ".join(copy)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in docs}
    want = {(a, b) for (a, ta), (b, tb) in itertools.combinations(docs, 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and ta != tb}
    first = {}
    for i, t in docs:
        first.setdefault(t, i)
    want = {(a, b) for a, b in want if first[dict(docs)[a]] == a and first[dict(docs)[b]] == b}
    got = similarity.similar_pairs(spark.createDataFrame(docs, "key long, text string"))
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 10
    groups = {r.key: r.group_key for r in similarity.near_duplicate_groups(spark.createDataFrame(docs, "key long, text string")).collect()}
    assert len(groups) == len(docs) and all(groups[a] == groups[b] for a, b in want)


def test_components_and_cliques(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 7), (5, 7)], "u long, v long")
    nodes = spark.range(1, 9).toDF("node")
    assert {r.node: r.root for r in components.components(links).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5}
    assert {r.node: r.root for r in components.cliques_or_singletons(nodes, links).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8}


def test_combine(spark):
    rows = [("a", 1, "no", 0.5, False), ("a", 2, "yes", 0.5, True), ("a", 3, "not covered by this part", 0.9, False), ("b", 1, "unknown", 0.1, False), ("b", 2, "not_documented", 0.1, False), ("c", 1, "not covered by this part", 0.1, False), ("d", 2, "y", 0.7, False), ("d", 1, "x", 0.7, False)]
    df = spark.createDataFrame(rows, "unit string, part int, value string, probability double, failed boolean")
    get = lambda out: {r.unit: r.value for r in out.collect()}
    assert get(combine.first_section(df)) == {"a": "no", "b": "not_documented", "c": "not_documented", "d": "x"}
    assert get(combine.highest_probability(df))["d"] == "x"
    assert get(combine.combined_list(df, ("x", "y", "both")))["d"] == "both"
    assert get(combine.any_yes(df.where("unit <> 'd'"))) == {"a": "no", "b": "not_documented", "c": "not_documented"}


def test_apportionment(spark):
    levels = lambda rows: spark.createDataFrame(rows, "level string, available long, floor long")
    targets = lambda rows, size: {r.level: r.target for r in sampling.level_targets(levels(rows), size).collect()}
    assert targets([("a", 10, 5), ("b", 30, None), ("c", 60, None)], 20) == {"a": 5, "b": 5, "c": 10}
    assert targets([("a", 4, None), ("b", 4, None), ("c", 4, None), ("d", 0, None)], 5) == {"a": 2, "b": 2, "c": 1, "d": 0}
    for rows, size in (([("a", 3, 4), ("b", 9, None)], 5), ([("a", 3, 3)], 2), ([("a", 3, 3), ("b", 1, None)], 5)):
        with pytest.raises(sampling.ShortDraw):
            sampling.level_targets(levels(rows), size)
    assert sampling.water_fill({"x": 2, "y": 50, "z": 50}, {"x": 1000, "y": 30, "z": 10}, 10) == {"x": 2, "y": 6, "z": 2}
    with pytest.raises(sampling.ShortDraw):
        sampling.water_fill({"x": 2}, {"x": 1}, 3)


def test_draws_do_not_depend_on_partitions_and_refuse_to_be_short(spark):
    pool = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 5000.0).alias("w"))
    a = [(r.k, r.draw_pos) for r in sampling.draw_uniform(pool.repartition(7), 20, 1, "k").orderBy("draw_pos").collect()]
    assert a == [(r.k, r.draw_pos) for r in sampling.draw_uniform(pool.coalesce(1), 20, 1, "k").orderBy("draw_pos").collect()]
    assert a[:5] == [(r.k, r.draw_pos) for r in sampling.draw_uniform(pool, 5, 1, "k").orderBy("draw_pos").collect()]
    assert sampling.draw_two_tier(pool.where("k < 10"), pool.where("k >= 10"), 15, 2, "k", "w").count() == 15
    with pytest.raises(sampling.ShortDraw):
        sampling.draw_weighted(pool, 201, 1, "k", "w")


def test_packing_against_a_loop(spark):
    rng = random.Random(2)
    items = [(g, i, rng.randint(1, 60)) for g in "ab" for i in range(50)]
    got = {(r.g, r.i): r.chunk for r in packing.greedy_chunks(spark.createDataFrame(items, "g string, i int, s long"), "g", "i", "s", 100, 4).collect()}
    for g in "ab":
        chunk = used = n = 0
        for _, i, s in (x for x in items if x[0] == g):
            if n and (used + s > 100 or n >= 4):
                chunk, used, n = chunk + 1, 0, 0
            used, n = used + s, n + 1
            assert got[g, i] == chunk


def test_salvage_and_violations(spark):
    row = spark.createDataFrame([("confirms_activity", "_NA_", "x"), ("confirms_activity", "_NA_", "_NA_"), ("ambiguous", "pilot", "_NA_"), ("ambiguous", "pilot", "name")], "genai_evidence string, adoption_stage string, activity_name string")
    fields = ["adoption_stage", "activity_name"]
    s = repair.salvage_missing(row, fields).collect()
    assert [(r.adoption_stage, r.salvaged_fields, r.unsalvageable_fields) for r in s] == [("unknown", ["adoption_stage"], []), ("_NA_", [], ["activity_name"]), ("pilot", [], []), ("pilot", [], [])]
    n = repair.salvage_negative(row, fields).collect()
    assert [(r.adoption_stage, r.blanked_fields, r.contradictory_fields) for r in n][2:] == [("_NA_", ["adoption_stage"], []), ("pilot", [], ["activity_name"])]
    assert [one(spark, repair.salvage_flags(F.lit(f))) for f in ("a; b", " ", " _NA_ ", "NA")] == ["a;b", "none", "none", "NA"]


def test_costs(spark):
    usage = spark.createDataFrame([("s", "m", 2.0), ("s", "n", 1.0), ("t", "m", 1.0)], "stage string, model string, units double")
    prices = spark.createDataFrame([("m", 0.5)], "model string, price double")
    assert {r.stage: r.usd for r in cost.priced_totals(usage, prices, "stage").collect()} == {"s": None, "t": 0.5}
    shared = spark.createDataFrame([("x", 1, 0.0, 10.0)] * 3 + [("x", 2, 5.0, 20.0)], "stage string, chunk int, start double, end double")
    assert [(r.work_s, r.wall_s) for r in cost.timing_summary(shared).collect()] == [(25.0, 20.0)]


def test_spans(spark):
    a = spark.createDataFrame([("p", 1, 0, 100), ("p", 2, 50, 50), ("p", 3, 200, 210)], "page string, id int, start int, end int")
    b = spark.createDataFrame([("p", 9, 99, 300), ("q", 8, 0, 500)], "page string, id int, start int, end int")
    assert sorted((r.a_id, r.b_id) for r in resolve.overlapping(a, b, "page", 16).collect()) == [(1, 9), (3, 9)]
    assert [r.id for r in resolve.not_overlapping(a, b, "page", 16).collect()] == [2]


def test_integrity(spark):
    out = integrity.keep_wins(spark.createDataFrame([("a",), ("b",), ("c",)], "url string"), spark.createDataFrame([("a", "drop"), ("a", "keep"), ("b", "drop"), ("z", "keep")], "url string, decision string")).collect()
    assert {r.url: (r.status, r.duplicate_url) for r in out} == {"a": ("kept", True), "b": ("dropped", False), "c": ("missing_decision", False), "z": ("url_mismatch", False)}


def test_html():
    page = "<html><head><title>t</title></head><body><nav>Home <a href='/x'>X</a></nav><main><p>A long line of real text stands here.</p><script>bad()</script><p>menu</p><p>7 items</p><a href='y#f'> Y  z </a><a href='mailto:a@b.c'>m</a></main></body></html>"
    main, chrome, links = html.parse(page, "https://a.b/c/d")
    assert main == "A long line of real text stands here.\n7 items" and "Home" in chrome
    assert links == [("https://a.b/x", "X"), ("https://a.b/c/y", "Y z")]


def test_streams_equal_the_batch_folds(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"host": f"h{rng.randrange(3)}", "seq": i, "ok": rng.random() < 0.4, "stage": f"s{i % 2}", "units": float(i % 5)} for i in range(60)]
    schema = "host string, seq long, ok boolean, stage string, units double"
    for part in range(3):
        (tmp_path / f"in{part}.json").write_text("\n".join(map(json.dumps, rows[part * 20 : part * 20 + 20])))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in*.json"))
    query = events.spend_totals(stream).writeStream.format("memory").queryName("spend").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in schema.split(", ")) for r in rows], schema)
    assert sorted(map(tuple, spark.table("spend").collect())) == sorted(map(tuple, events.spend_totals(batch).collect()))
    query = events.host_breaker_stream(stream, 3).writeStream.format("memory").queryName("breaker").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    last = {}
    for r in events.host_breaker(batch, 3).orderBy("seq").collect():
        last[r.host] = (r.failures, r.is_open)
    streamed = spark.table("breaker").collect()
    assert {h: (f, o) for h, (f, o) in last.items()} == {r.host: (r.failures, r.is_open) for r in streamed if (r.failures, r.is_open) == last[r.host]}


def test_run_status(spark):
    log = [("a", 1, "stage_started", "s1"), ("a", 2, "completed", None), ("b", 1, "failed", None), ("b", 2, "resumed", None), ("b", 3, "stage_started", "s2"), ("c", 1, "stage_started", "s1"), ("c", 2, "stage_completed", "s1")]
    out = events.run_status(spark.createDataFrame(log, "run_id string, seq long, event string, stage string")).collect()
    assert {r.run_id: (r.status, r.stage_in_flight) for r in out} == {"a": ("completed", None), "b": ("running", "s2"), "c": ("running", None)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('uid,name\n1,"a ""q"" b"\n2,\n')
    master = readers.strings_csv(spark, str(tmp_path / "m.csv"), ["uid", "name"])
    assert [r.name for r in master.orderBy("uid").collect()] == ['a "q" b', None]
    with pytest.raises(readers.MissingColumns):
        readers.strings_csv(spark, str(tmp_path / "m.csv"), ["country"])
    indexed = readers.with_row_index(spark.range(100).repartition(5).withColumnRenamed("id", "v"))
    assert sorted(r.row_index for r in indexed.collect()) == list(range(100))
    (tmp_path / "l.jsonl").write_text('{"stage": "s", "reason": "r"}\n{"stage": "t"')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), strict=False).count() == 1
    art = tmp_path / "art"
    art.mkdir()
    (art / "a.json").write_text('{"v": 1}')
    (art / "a.json.gz").write_bytes(gzip.compress(b'{"v": 2}'))
    (art / "b.json").write_text('{"v": 3}')
    assert sorted(r.v for r in readers.artifacts(spark, str(art), "v int").collect()) == [2, 3]
    (tmp_path / "s.csv").write_text("# snapshot_at=2024-01-01\nuid,n\nu,1\n")
    rows, stamp = readers.snapshot_csv(spark, str(tmp_path / "s.csv"))
    assert stamp == "2024-01-01" and rows.count() == 1
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w") as tar:
        info = tarfile.TarInfo("x.txt")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    files = spark.createDataFrame([("t.tar", bytearray(data.getvalue()))], "path string, content binary")
    assert [(r.member, r.size) for r in readers.tar_members(files).collect()] == [("x.txt", 3)]
    docs = spark.createDataFrame([(bytearray(packed.getvalue()),), (bytearray(b"no"),)], "c binary")
    assert [r[0] for r in docs.select(readers.docx_text("c")).collect()] == ["one\ntwo", None]
    writers.write_csv(master, str(tmp_path / "out"), ["name", "uid", "extra"], ["uid"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["name", "uid", "extra"]
    with pytest.raises(writers.Refused):
        writers.write_csv(master, str(tmp_path / "out2"), ["uid"], ["uid"])
    with pytest.raises(writers.Refused):
        writers.one_row_per(master.union(master), "uid")
    digest, changed = writers.refresh(master, str(tmp_path / "view"), None)
    assert changed and writers.refresh(master.repartition(3), str(tmp_path / "view"), digest) == (digest, False)
    nul = writers.without_nul(spark.createDataFrame([("a\0b", 1)], "s string, n int")).first()
    assert (nul.s, nul.nul_cells) == ("ab", 1)


def test_entry_works_without_the_llm_package(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "panelwright"), tmp_path / "panelwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'funnel_health' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_quotes():
    assert quotes.common_subsequence("abcbdab", "bdcaba") == 4 and quotes.common_subsequence("", "x") == 0
    rng = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert quotes.common_subsequence(a, b) == table[-1][-1]
    assert quotes.matched("The CAT’s hat", "a hat, the cat’s own hat") == (100.0, 1.0, "both")
    assert quotes.matched("", "x") == (0.0, None, None) and quotes.matched("ｆｕｌｌ", "full text")[2] == "both"
    assert quotes.matched("entirely other words", "nothing in common")[2] is None
    assert quotes.token_set_ratio(["fuzzy", "was", "a", "bear"], ["fuzzy", "fuzzy", "was", "a", "bear"]) == 100.0


def test_follow_is_bounded_and_nearest_first(spark):
    starts = spark.createDataFrame([("i", "a")], "institution string, url string")
    links = spark.createDataFrame([("a", f"b{k}", float(9 - k)) for k in range(9)] + [("b8", "c", 0.0), ("c", "d", 0.0), ("d", "e", 0.0), ("b8", "a", 0.0)], "url string, to string, nearness double")
    got = {r.url: r.hop for r in evidence.follow(starts, links, 3, 4).collect()}
    assert got == {"a": 0, "b8": 1, "b7": 1, "b6": 1, "b5": 1}
    assert {r.url: r.hop for r in evidence.follow(starts, links.where("url <> 'a' OR to = 'b8'"), 3, 10).collect()} == {"a": 0, "b8": 1, "c": 2, "d": 3}


def test_origins(spark):
    d = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x")], "record string, source string")
    assert sorted(map(tuple, evidence.origins(d, 5).collect())) == [("b", "a", False), ("c", "a", False), ("x", "x", True), ("y", "y", True)]


def test_breaker_stays_open(spark):
    rows = [("h", i, ok) for i, ok in enumerate([False, False, True, False])]
    out = events.host_breaker(spark.createDataFrame(rows, "host string, seq int, ok boolean"), 2).orderBy("seq").collect()
    assert [(r.failures, r.is_open) for r in out] == [(1, False), (2, True), (0, True), (1, True)]


def test_confidence_and_projection(spark):
    checks = spark.createDataFrame([("a", "supported", None), ("a", None, None), ("b", "downgraded_no_quote", None), ("b", None, None), ("c", "supported", None), ("d", "supported", "downgraded_low_confidence")], "s string, status string, second_reason string")
    cred = spark.createDataFrame([("c", "high"), ("d", "high")], "s string, credibility string")
    assert {r.s: r.confidence for r in evidence.source_confidence(checks, cred, "s").collect()} == {"a": "unfinished", "b": "low", "c": "high", "d": "low"}
    out = rows.public_projection(spark.createDataFrame([(1, "x", ["a@b.c", "d@b.c"])], "k int, secret string, mails array<string>"), ["secret"], "mails").first()
    assert out.asDict(True) == {"k": 1, "mails_by_domain": [{"domain": "b.c", "n": 2}]}


@pytest.mark.parametrize(
    ("written", "mined"),
    [
        ("FY25", {2025}), ("FY1949/50", {1949, 2050}), ("FY99/00", {1999, 2000}), ("B.E. 2566/67", {2023, 2024}), ("ปีงบประมาณ 2567-68", {2024, 2025}), ("2014-2020", {2014, 2020}), ("1850-2010", {2010}),
        ("p. 2012-2014", set()), ("2010-15", set()), ("2024-25", {2024}), ("令和元年度", {2019}), ("平成三十年", {2018}), ("民國113年", {2024}), ("2024-25年度", {2024, 2025}), ("FY 2014/15-2019/20", {2014, 2015, 2019, 2020}),
        ("2010-2012-2014", {2010, 2012, 2014}), ("FY 06/30/2024", {2024}), ("2010 to  2020", {2010, 2020}), ("Haushaltsjahr 2025/2026", {2025, 2026}), ("２０２４", {2024}), ("12345 20201", set()), ("", set()),
    ],
)
def test_years(written, mined):
    found = years.mine_years(f"x {written} y", 2026)
    assert {y for y, *_ in found} == mined and all(0 <= a < b <= len(written) + 4 for _, a, b, _ in found)


def test_domains_and_languages(spark):
    got = {h: one(spark, urls.registrable_domain(F.lit(h))) for h in ("https://www.a.b.co.uk/x", "x.y.example.org", "localhost", "10.0.0.1", "co.uk")}
    assert list(got.values()) == ["b.co.uk", "example.org", "localhost", "10.0.0.1", "co.uk"]
    english, spanish = "the river of the valley is and that was for the people " * 5, "el rio de los valles que por una vez es para las gentes " * 5
    assert [one(spark, language.identify(F.lit(t))) for t in (english, spanish, english + spanish, "the", None)] == ["en", "es", "mul", "unknown", "unknown"]


def test_halving_loses_nothing(spark):
    texts = [(1, "one. two. three. four. " * 20), (2, "x" * 100), (3, ""), (4, None)]

    def send(piece):
        if len(piece) > 60:
            raise packing.OverLimit
        return piece

    out = packing.with_halving(spark.createDataFrame(texts, "k long, t string"), "k", "t", send, depth=4).orderBy("key", "piece").collect()
    for k, t in texts:
        assert "".join(r.result for r in out if r.key == k) == (t or "") and not any(r.failed for r in out if r.key == k)
    assert all(r.failed for r in packing.with_halving(spark.createDataFrame(texts[1:2], "k long, t string"), "k", "t", send, depth=0).collect())
