"""Queries on sources and sinks: each writes to the session's shared folder, reads back and returns what came."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import shared_dir
from ..functions import dates, html, quotes, years
from ..operators import evidence, sampling
from ..session import table
from ..sources import readers, writers
from .fixtures import rows

_MADE: list[tuple] = []


def _place(spark, name):
    """A folder of its own in the shared folder, deleted at the latest when Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(sweep)
    _MADE.append((spark, path))
    return path


def sweep() -> None:
    """Delete what these queries wrote in this process."""
    while _MADE:
        spark, path = _MADE.pop()
        if spark.sparkContext._jsc is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _customers(spark, sf):
    return rows(spark, sf, "SELECT CAST(c_custkey AS STRING) AS uid, c_name || ', \"the\" office' AS name, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE 'line' || chr(10) || c_mktsegment END AS notes FROM {customer}")


def csv_round_trip(spark, sf):
    path = _place(spark, "csv")
    writers.write_csv(_customers(spark, sf), path, ["uid", "name", "notes", "extra"], ["uid"])
    return readers.strings_csv(spark, path, ["uid", "name"]).select("uid", "name", F.coalesce("notes", F.lit("")).alias("notes"), "extra")


def csv_rows_at(spark, sf):
    """Rows of a sorted CSV by their index, in draw order."""
    path = _place(spark, "drawn")
    writers.write_csv(rows(spark, sf, "SELECT c_custkey, c_name FROM {customer}"), path, ["c_custkey", "c_name"], ["c_custkey"])
    indexed = readers.with_row_index(readers.strings_csv(spark, path, ["c_custkey"]).orderBy(F.col("c_custkey").cast("long")))
    wanted = spark.range(40).select((F.col("id") * 3).alias("row_index"), (40 - F.col("id")).alias("draw_pos"))
    return readers.rows_at(indexed, wanted).select("row_index", "draw_pos", "c_custkey")


def _ledger(spark, sf):
    return rows(spark, sf, "SELECT CAST(event_id AS STRING) AS ts, 'i' || user_id AS institution_id, event_type AS stage, CASE event_id % 4 WHEN 0 THEN NULL ELSE 'r' || (event_id % 5) END AS reason, 'u' || event_id AS url, 'say \"x\"' AS detail FROM {events}")


def strict_ledger(spark, sf):
    path = _place(spark, "ledger")
    writers.write_json_lines(_ledger(spark, sf), path)
    return readers.json_lines(spark, path).groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("urls"))


def torn_ledger(spark, sf):
    """A ledger with torn lines: the whole ones are read."""
    path = _place(spark, "torn")
    whole = _ledger(spark, sf).select("url", F.to_json(F.struct("*")).alias("value"))
    whole.select(F.when(F.col("url").endswith("7"), F.substring("value", 1, 30)).otherwise(F.col("value")).alias("value")).write.text(path)
    return readers.json_lines(spark, path, strict=False).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def gzip_artifacts(spark, sf):
    path = _place(spark, "artifacts")
    writers.write_artifacts(rows(spark, sf, "SELECT o_orderkey AS id, o_orderstatus AS status FROM {orders}"), path)
    return spark.read.schema("id long, status string").option("recursiveFileLookup", True).json(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def snapshot_round_trip(spark, sf):
    path = _place(spark, "snapshot")
    writers.write_snapshot_csv(rows(spark, sf, "SELECT CAST(c_custkey AS STRING) AS uid, 'run' || c_nationkey AS last_run_id FROM {customer}"), path, "2026-01-02T03:04:05Z")
    back, at = readers.snapshot_csv(spark, path)
    return back.select("uid", "last_run_id", F.lit(at).alias("snapshot_at"))


def stage_durations(spark, sf):
    timing = rows(spark, sf, "SELECT user_id AS institution_id, event_type AS stage, CAST(sum(event_id % 9) AS DOUBLE) AS s FROM {events} GROUP BY user_id, event_type")
    made = timing.groupBy("institution_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", F.struct(F.lit("a").alias("start_time"), F.lit("b").alias("end_time"), F.col("s").alias("duration_seconds"), F.lit("done").alias("status"))))).alias("stages"))
    path = _place(spark, "timing")
    writers.write_json_lines(made, path)
    return readers.stage_times(spark.read.schema(f"institution_id long, stages map<string,struct<{readers.STAGE_TIME.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>").json(path)).select("institution_id", "stage", "duration_seconds", "status")


@F.pandas_udf(T.BinaryType())
def _tar_of(texts):
    import io
    import tarfile

    def packed(text):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for k, line in enumerate((text or "").split("\n")):
                info = tarfile.TarInfo(f"part{k}.txt")
                info.size = len(line.encode())
                tar.addfile(info, io.BytesIO(line.encode()))
        return out.getvalue()

    return texts.map(packed)


def tar_member_digests(spark, sf):
    files = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace(F.coalesce("text", F.lit("")), r"\n", " ").alias("text")))).alias("t")).select(F.col("conv_id").cast("string").alias("path"), F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))
    return readers.tar_members(files.select("path", _tar_of("text").alias("content")))


def tar_verification(spark, sf):
    """Archived members against the source: each is missing, extra, or differs."""
    from ..operators.integrity import compare

    key = lambda df: df.select(F.concat_ws("/", "path", "member").alias("key"), "sha256")
    found = tar_member_digests(spark, sf)
    source = key(found).withColumn("sha256", F.when(F.col("key").endswith("0/part0.txt"), F.lit("other")).otherwise(F.col("sha256"))).where("NOT endswith(key, '1/part0.txt')")
    return compare(key(found), source, "key", "sha256")


@F.pandas_udf(T.BinaryType())
def _docx_of(texts):
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def packed(text):
        if text is None:
            return b"no package"
        body = "".join(f"<w:p><w:r><w:t>{escape(''.join(c for c in line if c >= ' '))}</w:t></w:r></w:p>" for line in text.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    return texts.map(packed)


def docx_paragraphs(spark, sf):
    c = rows(spark, sf, "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN NULL ELSE n_name || ' & <b>' || chr(10) || 'R' || n_regionkey END AS text FROM {nation}")
    made = c.select("n_nationkey", _docx_of("text").alias("content"))
    return made.select("n_nationkey", readers.docx_text("content").alias("text"), readers.kind_of(F.col("content"), F.lit("text/html"), F.lit("x")).alias("kind"))


def shard_files(spark, sf):
    path = _place(spark, "shards")
    table(spark, sf, "customer").withColumn("shard", F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 1)).repartition("shard").write.partitionBy("shard").parquet(path)
    return readers.shard_census(spark, path).where("shard LIKE 'shard=%'").select("shard", "files", (F.col("bytes") > 0).alias("filled"))


def checksum_lines(spark, sf):
    return writers.sha256sums(table(spark, sf, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".txt")).alias("name"), "c_name"), "name", "c_name")


def nul_free_rows(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("\0x\0")).otherwise(F.lit(""))).alias("name"), F.when(F.col("c_custkey") % 5 == 0, F.lit("\0")).alias("other"))
    return writers.without_nul(c)


def refused_repeats(spark, sf):
    """What the sinks refuse: a repeated key, a column without a place, a folder that is there."""
    o = rows(spark, sf, "SELECT o_custkey, o_orderkey FROM {orders}")
    path = _place(spark, "refused")
    tries = {
        "repeated_key": lambda: writers.one_row_per(o, "o_custkey"), "unique_key": lambda: writers.one_row_per(o, "o_orderkey"),
        "extra_column": lambda: writers.write_csv(o, path, ["o_custkey"], ["o_custkey"]), "written": lambda: writers.write_csv(o, path, o.columns, ["o_orderkey"]),
        "again": lambda: writers.write_csv(o, path, o.columns, ["o_orderkey"]),
    }
    said = []
    for name, run in tries.items():
        try:
            run()
            said.append((name, False))
        except Exception:  # noqa: BLE001  (each kind of refusal counts)
            said.append((name, True))
    return spark.createDataFrame(said, "what string, refused boolean")


def view_refresh(spark, sf):
    """A view is written when its rows change, not when only their order does."""
    path, o = _place(spark, "view"), rows(spark, sf, "SELECT o_orderkey, o_orderstatus FROM {orders}")
    first, wrote = writers.refresh(o, path, None)
    second, again = writers.refresh(o.repartition(3).orderBy("o_orderstatus"), path, first)
    third, changed = writers.refresh(o.where("o_orderkey > 5"), path, second)
    return spark.createDataFrame([(wrote, again, changed, first == second, second == third)], "wrote boolean, again boolean, changed boolean, same boolean, last_same boolean")


def expanded_layout(spark, sf):
    r = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("new_b"))
    out = writers.expanded(r, ["r_regionkey", "r_name"], ["new_a", "new_b"])
    return out.select(F.lit(",".join(out.columns)).alias("layout"), *out.columns)


def persisted_run(spark, sf):
    """Three tables written as one run, read back from their files and counted."""
    path = _place(spark, "run")
    a = rows(spark, sf, "SELECT o_orderkey AS id, o_custkey AS inst, o_orderstatus AS status FROM {orders}")
    s = rows(spark, sf, "SELECT l_orderkey AS activity, l_linenumber AS n, l_suppkey AS supplier FROM {lineitem}")
    u = a.groupBy("inst").agg(F.count(F.lit(1)).alias("n_activities"))
    tables = {"activities": (a, ["id", "inst", "status"], ["id"]), "sources": (s, ["activity", "n", "supplier"], ["activity", "n"]), "summary": (u, ["inst", "n_activities"], ["inst"])}
    writers.write_run(path, 1, tables, {"orphans": s.join(a.select(F.col("id").alias("activity")), "activity", "left_anti")})
    counted = [spark.read.option("header", True).csv(f"{path}/{name}_v1.csv").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(F.col(cols[0]).cast("long")).alias("keys")) for name, (_, cols, _) in tables.items()]
    return counted[0].union(counted[1]).union(counted[2])


def outcome_report(spark, sf):
    path = _place(spark, "report")
    writers.write_report(rows(spark, sf, "SELECT c_custkey AS inst, CASE c_custkey % 3 WHEN 0 THEN 'found' ELSE 'none' END AS outcome FROM {customer}"), path, "inst")
    lines = readers.json_lines(spark, f"{path}/jsonl", "inst long, outcome string")
    cells = readers.strings_csv(spark, f"{path}/csv", ["inst"]).select(F.col("inst").cast("long"), "outcome")
    return lines.join(cells, ["inst", "outcome"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def bundle_inventory(spark, sf):
    files = rows(spark, sf, "SELECT 's' || (p_partkey % 7) AS shard, p_name AS path, p_size AS bytes FROM {part}").select("shard", "path", "bytes", F.sha2("path", 256).alias("sha256"))
    shards = files.groupBy("shard").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    path = _place(spark, "inventory")
    writers.inventory(files, shards, "run9").write.text(path)
    back = spark.read.schema("kind string, run_id string, n_shards long, shard string, files long, bytes long, path string, sha256 string").json(path)
    return back.groupBy("kind", "run_id", "n_shards").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def frame_file_order(spark, sf):
    """A frame written in draw order comes back in it."""
    path = _place(spark, "frame")
    draw = sampling.draw_uniform(table(spark, sf, "customer").select("c_custkey"), 120, 7, "c_custkey")
    writers.write_in_draw_order(draw, path, ["draw_pos", "c_custkey"])
    return spark.read.option("header", True).schema("draw_pos int, c_custkey long").csv(path)


def two_tier_draw(spark, sf):
    first = rows(spark, sf, "SELECT c_custkey, 1.0 AS age FROM {customer} WHERE c_custkey % 30 = 1")
    second = rows(spark, sf, "SELECT c_custkey, CAST(c_custkey * 5000 AS DOUBLE) AS age FROM {customer} WHERE c_custkey % 30 = 2")
    have = first.count()
    return sampling.draw_two_tier(first, second, have + 3, 9, "c_custkey", "age").withColumn("tier", F.when(F.col("draw_pos") <= have, 1).otherwise(2)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_custkey") % 30 == 1).alias("from_first"))


def pdf_dates(spark, sf):
    e = rows(spark, sf, "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'D:20240506070809Z' WHEN 1 THEN 'D:202405' WHEN 2 THEN '2024' WHEN 3 THEN 'D:20241399' WHEN 4 THEN ' D:20240506 ' WHEN 5 THEN 'no' ELSE NULL END AS raw FROM {events}")
    return e.select("event_id", dates.normalise_pdf(F.col("raw")).alias("value"))


def publication_dates(spark, sf):
    o = rows(spark, sf, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '2020' END AS meta, CASE o_orderkey % 2 WHEN 0 THEN '2021' END AS quoted FROM {orders}")
    return o.select("o_orderkey", evidence.publication_date(F.col("meta"), F.col("quoted")).alias("published"))


def two_digit_years(spark, sf):
    made = [(yy, years.two_digit_year(yy, 2026)) for yy in range(100)]
    return spark.createDataFrame(made, "yy int, year int")


def ascii_digits(spark, sf):
    made = [(k, years.plain_digits("".join(chr(base + k) for base in (0x30, 0x660, 0x6F0, 0x966, 0xE50, 0xFF10)))) for k in range(10)]
    return spark.createDataFrame(made, "digit int, spelled string")


def token_words(spark, sf):
    """How many words the tokens of each document's first lines are, by the plain letters alone."""
    count = F.pandas_udf(lambda texts: texts.map(lambda t: len(quotes.word_tokens(t or ""))), T.IntegerType())
    d = table(spark, sf, "part").select("p_partkey", count(F.concat(F.col("p_name"), F.lit(", it's 2 "))).alias("n"))
    return d


DATED = "<html><head><meta name='DC.Date.Issued' content='{0}'><meta property='article:published_time' content='x'><script type='application/ld+json'>{{\"@graph\": [{{\"datePublished\": \"{0}-05\"}}]}}</script></head><body><div itemscope itemtype='https://schema.org/Article'><time itemprop='datePublished' datetime='{0}-05-06T01:02:03Z'>May</time></div><time itemprop='datePublished' datetime='{0}'>outside</time></body></html>"


def html_dates(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.lit(DATED.replace("{{", "{").replace("}}", "}")), r"\{0\}", F.concat(F.lit("20"), F.lpad((F.col("page_id") % 20 + 10).cast("string"), 2, "0"))).alias("html"))
    return html.dates(pages).select(F.col("key").alias("page_id"), "place", "tag", "found_as", "value")


def page_date_inputs(spark, sf):
    """Of a page's date signals those in the window, and the dates of its URL."""
    d = html_dates(spark, sf).where("value IS NOT NULL")
    kept = d.where(dates.in_window(F.col("value"), F.lit("2024-06-01")))
    return kept.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]), "|").alias("in_window"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_round_trip, csv_rows_at, strict_ledger, torn_ledger, gzip_artifacts, snapshot_round_trip, stage_durations, tar_member_digests, tar_verification, docx_paragraphs, shard_files,
        checksum_lines, nul_free_rows, refused_repeats, view_refresh, expanded_layout, persisted_run, outcome_report, bundle_inventory, frame_file_order, two_tier_draw, pdf_dates,
        publication_dates, two_digit_years, ascii_digits, token_words, html_dates, page_date_inputs,
    )
}

_PARTS = "WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS path, regexp_replace(coalesce(text, ''), '\\n', ' ', 'g') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, regexp_replace(coalesce(text, ''), '\\n', ' ', 'g')) - 1 AS k FROM conversations), m AS (SELECT path, 'part' || k || '.txt' AS member, octet_length(encode(t)) AS size, sha256(t) AS sha256 FROM p) "
_DRAW = "(CAST('0x' || left(md5('7|' || c_custkey), 13) AS BIGINT) + 0.5) / 4503599627370496.0"
_YEAR = "'20' || lpad(CAST(page_id % 20 + 10 AS VARCHAR), 2, '0')"
_DATES = f"WITH d AS (SELECT page_id, {_YEAR} AS y FROM pages), v AS (SELECT page_id, 1 AS place, 'dcterms.issued' AS tag, 'meta' AS found_as, y AS value FROM d UNION ALL SELECT page_id, 2, 'article:published_time', 'meta', NULL FROM d UNION ALL SELECT page_id, 3, 'schema.org datePublished', 'json-ld', y || '-05' FROM d UNION ALL SELECT page_id, 4, 'schema.org datePublished', 'microdata', y || '-05-06' FROM d) "
ORACLES = {
    "csv_round_trip": "SELECT CAST(c_custkey AS VARCHAR) AS uid, c_name || ', \"the\" office' AS name, CASE c_custkey % 3 WHEN 0 THEN '' ELSE 'line' || chr(10) || c_mktsegment END AS notes, CAST(NULL AS VARCHAR) AS extra FROM customer",
    "csv_rows_at": "WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row_index FROM customer) SELECT row_index, 40 - row_index // 3 AS draw_pos, CAST(c_custkey AS VARCHAR) AS c_custkey FROM n WHERE row_index % 3 = 0 AND row_index < 120",
    "strict_ledger": "SELECT event_type AS stage, CASE event_id % 4 WHEN 0 THEN NULL ELSE 'r' || (event_id % 5) END AS reason, count(*) AS n, count(DISTINCT event_id) AS urls FROM events GROUP BY 1, 2",
    "torn_ledger": "SELECT event_type AS stage, count(*) AS n FROM events WHERE event_id % 10 <> 7 GROUP BY 1",
    "gzip_artifacts": "SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders GROUP BY 1",
    "snapshot_round_trip": "SELECT CAST(c_custkey AS VARCHAR) AS uid, 'run' || c_nationkey AS last_run_id, '2026-01-02T03:04:05Z' AS snapshot_at FROM customer",
    "stage_durations": "SELECT user_id AS institution_id, event_type AS stage, CAST(sum(event_id % 9) AS DOUBLE) AS duration_seconds, 'done' AS status FROM events GROUP BY 1, 2",
    "tar_member_digests": _PARTS + "SELECT * FROM m",
    "tar_verification": _PARTS + "SELECT path || '/' || member AS key, CASE WHEN ends_with(path, '1') THEN 'missing' ELSE 'differs' END AS status FROM m WHERE member = 'part0.txt' AND (ends_with(path, '0') OR ends_with(path, '1'))",
    "docx_paragraphs": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN NULL ELSE n_name || ' & <b>' || chr(10) || 'R' || n_regionkey END AS text, CASE n_nationkey % 4 WHEN 0 THEN 'html' ELSE 'docx' END AS kind FROM nation",
    "shard_files": "SELECT DISTINCT 'shard=' || left(md5(CAST(c_custkey AS VARCHAR)), 1) AS shard, CAST(1 AS BIGINT) AS files, true AS filled FROM customer",
    "checksum_lines": "SELECT sha256(c_name) || '  ' || c_custkey || '.txt' AS value FROM customer",
    "nul_free_rows": "SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END AS name, CASE WHEN c_custkey % 5 = 0 THEN '' END AS other, CAST(CAST(c_custkey % 3 = 0 AS INT) + CAST(c_custkey % 5 = 0 AS INT) AS INTEGER) AS nul_cells FROM customer",
    "refused_repeats": "SELECT * FROM (VALUES ('repeated_key', true), ('unique_key', false), ('extra_column', true), ('written', false), ('again', true)) t(what, refused)",
    "view_refresh": "SELECT true AS wrote, false AS again, true AS changed, true AS same, false AS last_same",
    "expanded_layout": "SELECT 'r_regionkey,r_name,new_a,new_b' AS layout, r_regionkey, CAST(NULL AS VARCHAR) AS r_name, CAST(NULL AS VARCHAR) AS new_a, r_name AS new_b FROM region",
    "persisted_run": "SELECT 'activities' AS name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders UNION ALL SELECT 'sources', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem UNION ALL SELECT 'summary', count(DISTINCT o_custkey), CAST(sum(DISTINCT o_custkey) AS BIGINT) FROM orders",
    "outcome_report": "SELECT CASE c_custkey % 3 WHEN 0 THEN 'found' ELSE 'none' END AS outcome, count(*) AS n FROM customer GROUP BY 1",
    "bundle_inventory": "SELECT 'run' AS kind, 'run9' AS run_id, count(DISTINCT p_partkey % 7) AS n_shards, CAST(1 AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS bytes FROM part UNION ALL SELECT 'shard', NULL, NULL, count(DISTINCT p_partkey % 7), CAST(sum(p_size) AS BIGINT) FROM part UNION ALL SELECT 'file', NULL, NULL, count(*), CAST(sum(p_size) AS BIGINT) FROM part",
    "frame_file_order": f"SELECT CAST(row_number() OVER (ORDER BY u, c_custkey) AS INTEGER) AS draw_pos, c_custkey FROM (SELECT c_custkey, {_DRAW} AS u FROM customer) QUALIFY draw_pos <= 120",
    "two_tier_draw": "WITH n AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 30 = 1) SELECT 1 AS tier, n, n AS from_first FROM n UNION ALL SELECT 2, 3, 0",
    "pdf_dates": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN '2024-05-06' WHEN 1 THEN '2024-05' WHEN 2 THEN '2024' WHEN 4 THEN '2024-05-06' END AS value FROM events",
    "publication_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2020' WHEN o_orderkey % 2 = 0 THEN '2021' ELSE 'not_documented' END AS published FROM orders",
    "two_digit_years": "SELECT CAST(yy AS INTEGER) AS yy, CAST(CASE WHEN yy >= 51 THEN 1900 ELSE 2000 END + yy AS INTEGER) AS year FROM range(100) t(yy)",
    "ascii_digits": "SELECT CAST(d AS INTEGER) AS digit, repeat(CAST(d AS VARCHAR), 6) AS spelled FROM range(10) t(d)",
    "token_words": r"SELECT p_partkey, CAST(len(regexp_extract_all(p_name, '[\p{L}\p{N}]+')) + 2 AS INTEGER) AS n FROM part",
    "html_dates": _DATES + "SELECT * FROM v",
    "page_date_inputs": _DATES + "SELECT page_id, string_agg(value, '|' ORDER BY place) AS in_window FROM v WHERE value IS NOT NULL AND substring(value || '-01-01', 1, 10) <= '2024-06-01' GROUP BY 1",
}
