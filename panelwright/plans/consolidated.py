"""Queries on consolidated panels: persisted rows, summaries, quality counts, contract rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consolidated as C
from ..session import table
from .fixtures import ACTIVITIES, INSTITUTIONS, LEDGER, SOURCES, ctes, rows


def _panel(spark, sf):
    return tuple(rows(spark, sf, s) for s in (INSTITUTIONS, ACTIVITIES, SOURCES))


PANEL = ctes(inst=INSTITUTIONS, act=ACTIVITIES, src=SOURCES)


def salvage_map(spark, sf):
    return C.salvaged_fields(rows(spark, sf, LEDGER))


def source_rows(spark, sf):
    return C.source_rows(rows(spark, sf, SOURCES), C.salvaged_fields(rows(spark, sf, LEDGER)), "run1").select("global_row_id", "inst", "source_id", "activity_id", "url", "salvaged_fields")


def summary_rows(spark, sf):
    return C.summary_rows(*_panel(spark, sf), "run1").drop("name", "country", "level", "summary")


def _spelled(df, *maps):
    spell = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["value"], e["n"].cast("string"))), ",")
    return df.withColumns({c: F.coalesce(spell(F.col(c)), F.lit("")) for c in maps})


def qc_per_institution(spark, sf):
    out = _spelled(C.qc_institutions(*_panel(spark, sf)), "by_credibility", "by_source_type", "by_evidence")
    return out.withColumns({c: F.array_join(c, ",") for c in ("with_flags", "high_confidence", "weak_signal", "speculative")})


def qc_per_run(spark, sf):
    return C.qc_run(C.qc_institutions(*_panel(spark, sf)))


def _flagged(spark, sf, column):
    _, activities, sources = _panel(spark, sf)
    return C.activity_signals(activities, sources).where(column).select("inst", "activity_id")


def weak_signal_activities(spark, sf):
    return _flagged(spark, sf, "weak_signal")


def speculative_activities(spark, sf):
    return _flagged(spark, sf, "speculative")


#: Chunk responses: an institution's orders fall into three chunks.
CHUNKS = """SELECT c_custkey AS inst, k AS chunk, CASE (c_custkey + k) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'unclear' ELSE 'no' END AS verdict,
    'chunk ' || k || ' of ' || c_name AS summary, (c_custkey * (k + 1)) % 5 AS n_rows FROM {customer} CROSS JOIN (VALUES (0), (1), (2)) AS t(k)"""
CHUNK_ACTIVITIES = f"SELECT a.*, pos % 3 AS chunk FROM ({ACTIVITIES}) a"
CHUNK_SOURCES = f"SELECT s.*, CAST(substring(source_id, 2) AS BIGINT) % 3 AS chunk FROM ({SOURCES}) s"
PLACEHOLDERS = {"tool": ("unknown", ""), "vendor": ("unknown", "")}


def _merged(spark, sf):
    return C.merged_chunks(rows(spark, sf, CHUNKS), rows(spark, sf, CHUNK_ACTIVITIES), rows(spark, sf, CHUNK_SOURCES), PLACEHOLDERS)


def merged_chunk_institutions(spark, sf):
    return _merged(spark, sf)[0]


def merged_chunk_activities(spark, sf):
    return _merged(spark, sf)[1]


def merged_chunk_sources(spark, sf):
    return _merged(spark, sf)[2]


def verdict_rules_v25(spark, sf):
    return C.verdict_violations(*_panel(spark, sf), "2.5")


def verdict_rules_v27(spark, sf):
    return C.verdict_violations(*_panel(spark, sf), "2.7")


def link_rules_v25(spark, sf):
    return C.link_violations(*_panel(spark, sf)[1:], "2.5")


def link_rules_v27(spark, sf):
    return C.link_violations(*_panel(spark, sf)[1:], "2.7")


def declared_source_counts(spark, sf):
    return C.declared_sources(*_panel(spark, sf)[1:])


COPY = f"SELECT inst, CASE WHEN inst % 11 = 0 THEN NULL ELSE name END AS name, CASE WHEN inst % 13 = 0 THEN 'N99' ELSE country END AS country, level FROM ({INSTITUTIONS}) i WHERE inst % 17 <> 0"


def metadata_differences(spark, sf):
    return C.field_differences(rows(spark, sf, INSTITUTIONS), rows(spark, sf, COPY), "inst", ["name", "country", "level"])


def envelope_links(spark, sf):
    institutions, activities, sources = _panel(spark, sf)
    return C.envelope_violations(institutions.where("inst % 19 <> 0"), activities, sources)


def _orders_files(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    whole = F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "status": "'), F.col("o_orderstatus"), F.lit('"}'))
    body = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.concat(F.lit('{"id": '), k.cast("string"))).when(k % 5 == 2, F.lit("broken]")).otherwise(whole)
    return o.select(k.alias("key"), body.alias("body"))


def document_status(spark, sf):
    files = _orders_files(spark, sf)
    held = files.where("key % 7 = 0").select("key")
    return C.parsed_documents(files, "id long, status string", held).select("key", "status", F.col("doc.id").alias("id"), F.col("doc.status").alias("value"))


#: Reviewed pages: line items by the customer's order.
PAGES = """SELECT o_custkey AS inst, CASE l_linestatus WHEN 'O' THEN 'web' ELSE 'text' END AS channel, l_linenumber <> 3 AS reviewed, l_partkey % 41 = 0 AS failed, l_linenumber > 4 AS followed,
    CASE WHEN o_custkey % 4 <> 1 AND l_partkey % 3 = 0 THEN 'confirms_activity' WHEN l_partkey % 3 = 1 THEN 'no_genai' ELSE 'not_assessable' END AS verdict,
    CASE WHEN l_partkey % 3 = 1 THEN 'supported' ELSE 'set_by_rule' END AS support FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_custkey % 4 <> 1 OR (l_linenumber <> 3 AND l_partkey % 41 <> 0 AND l_partkey % 3 <> 0)"""
TIERED = """SELECT o_custkey AS inst, CASE o_orderkey % 4 WHEN 0 THEN 'deployment' WHEN 1 THEN 'governance' WHEN 2 THEN 'program' ELSE 'other' END AS action,
    CASE o_orderkey % 5 WHEN 0 THEN 'announced' WHEN 1 THEN 'pilot' WHEN 2 THEN 'proposed' ELSE 'unknown' END AS stage,
    CASE o_orderkey % 9 WHEN 0 THEN 'tender_or_rfp' ELSE 'none' END AS purchase FROM {orders} WHERE o_custkey % 4 > 1"""


def review_depth(spark, sf):
    return _spelled(C.review_depth(rows(spark, sf, PAGES)), "by_verdict")


def institution_verdicts(spark, sf):
    return C.institution_verdicts(rows(spark, sf, PAGES), rows(spark, sf, TIERED))


def contact_answer(spark, sf):
    answers = rows(spark, sf, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS a, CASE o_custkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN NULL ELSE 'no' END AS b FROM {orders}")
    return answers.select("o_orderkey", C.three_valued_or(F.col("a"), F.col("b")).alias("answer"))


def ambiguous_stages(spark, sf):
    return C.ambiguous(rows(spark, sf, ACTIVITIES), "inst", "stage", ("announced",))


def unanimous_dates(spark, sf):
    return C.unanimous(rows(spark, sf, "SELECT l_orderkey AS unit, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE CAST(l_suppkey % 3 AS STRING) END AS value FROM {lineitem}"), "unit", "value")


def supporting_sources(spark, sf):
    found = C.ordered_distinct(rows(spark, sf, "SELECT l_orderkey AS unit, l_linenumber AS at, 's' || (l_suppkey % 4) AS source FROM {lineitem}"), "unit", "at", "source")
    return found.select("unit", F.array_join("values", "|").alias("sources"))


def renumbered_sources(spark, sf):
    return C.renumbered(rows(spark, sf, SOURCES), "inst", "pos", "S", "source_id")


QUERIES = {
    f.__name__: f
    for f in (
        salvage_map, source_rows, summary_rows, qc_per_institution, qc_per_run, weak_signal_activities, speculative_activities, merged_chunk_institutions,
        merged_chunk_activities, merged_chunk_sources, verdict_rules_v25, verdict_rules_v27, link_rules_v25, link_rules_v27, declared_source_counts,
        metadata_differences, envelope_links, document_status, review_depth, institution_verdicts, contact_answer, ambiguous_stages, unanimous_dates,
        supporting_sources, renumbered_sources,
    )
}


def _words(keywords):
    """The keyword screen for RE2, which has no look-around: edges are matched as characters around the text."""
    parts = []
    for word in keywords:
        bare = "".join("\\" + c if c.isascii() and not (c.isalnum() or c == " ") else c for c in word)
        parts.append((r"[^\p{L}\p{M}\p{N}_]" if word[0].isalnum() else "") + bare + (r"s?[^\p{L}\p{M}\p{N}_]" if word[-1].isalnum() else ""))
    return "regexp_matches(' ' || lower(snippet) || ' ', '" + "|".join(parts) + "')"


SIGNALS = PANEL + f""", said AS (SELECT inst, activity_id, bool_or({_words(C.GENERATIVE)}) AS signal, bool_or({_words(C.FIRM)}) AS firm, bool_and({_words(C.HEDGED)}) AS hedged
      FROM src WHERE evidence = 'confirms_activity' AND activity_id <> '_NA_' GROUP BY 1, 2),
    sig AS (SELECT a.inst, a.activity_id, a.pos, coalesce(NOT signal, false) AS weak, coalesce(stage = 'announced' AND NOT firm AND hedged, false) AS spec FROM act a LEFT JOIN said s ON a.inst = s.inst AND a.activity_id = s.activity_id)"""
QC = SIGNALS + """, own AS (SELECT inst, count(*) AS n_activities, string_agg(activity_id, ',' ORDER BY pos) FILTER (flags <> 'none') AS with_flags, string_agg(activity_id, ',' ORDER BY pos) FILTER (confidence = 'high') AS high_confidence,
      string_agg(activity_id, ',' ORDER BY pos) FILTER (weak) AS weak_signal, string_agg(activity_id, ',' ORDER BY pos) FILTER (spec) AS speculative,
      count(*) FILTER (flags <> 'none') AS f, count(*) FILTER (confidence = 'high') AS h, count(*) FILTER (weak) AS w, count(*) FILTER (spec) AS s FROM act JOIN sig USING (inst, activity_id, pos) GROUP BY 1),
    n AS (SELECT inst, count(*) AS n_sources FROM src GROUP BY 1)"""


def _by(column):
    return f"(SELECT inst, string_agg(v || ':' || n, ',' ORDER BY v) AS by_{column} FROM (SELECT inst, {column} AS v, count(*) AS n FROM src GROUP BY 1, 2) GROUP BY 1)"


def _verdict(extra):
    return PANEL + """, f AS (SELECT inst, bool_or(evidence = 'confirms_activity') AS confirmed, bool_or(evidence = 'confirms_activity' AND {sound}) AS sound, bool_or(evidence = 'confirms_absence') AS negative, bool_or(evidence NOT IN ({permitted})) AS blocked FROM src GROUP BY 1),
      m AS (SELECT inst, verdict, inst IN (SELECT inst FROM act) AS active, coalesce(confirmed, false) AS confirmed, coalesce(sound, false) AS sound, coalesce(negative, false) AS negative, coalesce(blocked, false) AS blocked FROM inst LEFT JOIN f USING (inst))
      SELECT inst, rule FROM (SELECT inst, unnest([CASE WHEN verdict = 'yes' AND NOT active THEN 'yes_without_activity' END, CASE WHEN verdict = 'yes' AND NOT confirmed THEN 'yes_without_confirmation' END,
        CASE WHEN verdict = 'yes' AND confirmed AND NOT sound THEN 'yes_on_downgraded_only' END, CASE WHEN verdict = 'no' AND active THEN 'no_with_activity' END, CASE WHEN verdict = 'no' AND blocked THEN 'no_with_other_evidence' END,
        CASE WHEN verdict = 'no' AND NOT negative AND {negative} THEN 'no_without_negative' END, CASE WHEN verdict = 'unclear' AND active THEN 'unclear_with_activity' END,
        CASE WHEN verdict = 'unclear' AND sound THEN 'unclear_with_confirmation' END]) AS rule FROM m) WHERE rule IS NOT NULL""".format(**extra)


_OLD = {"sound": "true", "permitted": "'confirms_absence'", "negative": "false"}
_NEW = {"sound": "NOT coalesce(starts_with(support, 'downgraded_'), false)", "permitted": "'confirms_absence', 'not_assessable'", "negative": "true"}


def _links(excused):
    return PANEL + f""", m AS (SELECT s.*, a.activity_id IS NOT NULL AS known FROM src s LEFT JOIN act a ON a.inst = s.inst AND a.activity_id = s.activity_id),
      r AS (SELECT inst, source_id, CASE WHEN activity_id = '_NA_' AND evidence = 'confirms_activity' AND NOT {excused} THEN 'confirmation_without_activity' WHEN activity_id <> '_NA_' AND NOT known THEN 'unknown_activity'
        WHEN activity_id <> '_NA_' AND evidence <> 'confirms_activity' THEN 'link_without_confirmation' END AS rule FROM m) SELECT * FROM r WHERE rule IS NOT NULL"""


MERGED = ctes(chunk=CHUNKS, act=CHUNK_ACTIVITIES, src=CHUNK_SOURCES) + """,
    n AS (SELECT inst, activity_name, min((chunk, pos)) AS first,
        coalesce(arg_min(tool, (chunk, pos)) FILTER (tool NOT IN ('unknown', '')), arg_min(tool, (chunk, pos))) AS tool, coalesce(arg_min(vendor, (chunk, pos)) FILTER (vendor NOT IN ('unknown', '')), arg_min(vendor, (chunk, pos))) AS vendor,
        max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS c,
        list_sort(list_distinct(list_filter(flatten(list(string_split(flags, ';'))), lambda x: x NOT IN ('', 'none')))) AS fl FROM act GROUP BY 1, 2),
    num AS (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY first) AS number FROM n),
    lnk AS (SELECT DISTINCT a.inst, a.chunk, a.activity_id, number FROM act a JOIN num USING (inst, activity_name)),
    j AS (SELECT s.inst, s.chunk, s.pos, s.url, s.snippet, l.number FROM src s LEFT JOIN lnk l ON l.inst = s.inst AND l.chunk = s.chunk AND l.activity_id = s.activity_id),
    kept AS (SELECT * FROM (SELECT *, min(chunk) OVER (PARTITION BY inst, url, snippet, number) AS c0 FROM j) WHERE chunk = c0)"""

ORACLES = {
    "salvage_map": ctes(l=LEDGER) + ", n AS (SELECT * FROM l WHERE reason = 'salvaged' AND contains(detail, ';fields=')), w AS (SELECT inst, url, arg_max(detail, seq) AS d FROM n GROUP BY 1, 2) SELECT inst, url, array_to_string(list_sort(list_filter(string_split(string_split(d, ';fields=')[2], ','), lambda x: x <> '')), ';') AS fields FROM w",
    "summary_rows": PANEL + """, a AS (SELECT inst, count(*) AS n_activities, string_agg(activity_name, ' | ' ORDER BY pos) AS activities_found, string_agg(DISTINCT tool, ' | ' ORDER BY tool) FILTER (tool <> 'unknown') AS tools_found,
        string_agg(DISTINCT vendor, ' | ' ORDER BY vendor) FILTER (vendor <> 'unknown') AS vendors_found, max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS c FROM act GROUP BY 1),
      f AS (SELECT inst, string_agg(DISTINCT x, ';' ORDER BY x) AS flags FROM (SELECT inst, unnest(string_split(flags, ';')) AS x FROM act) WHERE x NOT IN ('', 'none') GROUP BY 1),
      s AS (SELECT inst, count(*) AS n_sources, count(*) FILTER (credibility = 'high') AS n_high, count(*) FILTER (credibility = 'medium') AS n_medium, count(*) FILTER (credibility = 'low') AS n_low FROM src GROUP BY 1)
      SELECT 'run1::' || inst || '::summary' AS global_row_id, inst, verdict, n_pages, coalesce(n_activities, 0) AS n_activities, coalesce(n_sources, 0) AS n_sources, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low,
        coalesce(activities_found, '') AS activities_found, coalesce(tools_found, '') AS tools_found, coalesce(vendors_found, '') AS vendors_found, CASE c WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE '_NA_' END AS best_confidence, coalesce(flags, 'none') AS flags
      FROM inst LEFT JOIN a USING (inst) LEFT JOIN f USING (inst) LEFT JOIN s USING (inst)""",
    "qc_per_institution": QC + f""" SELECT inst, verdict, coalesce(n_activities, 0) AS n_activities, coalesce(n_sources, 0) AS n_sources, coalesce(with_flags, '') AS with_flags, coalesce(high_confidence, '') AS high_confidence,
      coalesce(weak_signal, '') AS weak_signal, coalesce(speculative, '') AS speculative, coalesce(by_credibility, '') AS by_credibility, coalesce(by_source_type, '') AS by_source_type, coalesce(by_evidence, '') AS by_evidence
      FROM inst LEFT JOIN own USING (inst) LEFT JOIN n USING (inst) LEFT JOIN {_by('credibility')} USING (inst) LEFT JOIN {_by('source_type')} USING (inst) LEFT JOIN {_by('evidence')} USING (inst)""",
    "qc_per_run": QC + """ SELECT count(*) AS n_institutions, count(*) FILTER (verdict = 'yes') AS n_yes, count(*) FILTER (verdict = 'no') AS n_no, count(*) FILTER (verdict = 'unclear') AS n_unclear, CAST(sum(coalesce(n_activities, 0)) AS BIGINT) AS n_activities,
      CAST(sum(coalesce(n_sources, 0)) AS BIGINT) AS n_sources, CAST(sum(coalesce(f, 0)) AS BIGINT) AS n_with_flags, CAST(sum(coalesce(h, 0)) AS BIGINT) AS n_high_confidence, CAST(sum(coalesce(w, 0)) AS BIGINT) AS n_weak_signal, CAST(sum(coalesce(s, 0)) AS BIGINT) AS n_speculative
      FROM inst LEFT JOIN own USING (inst) LEFT JOIN n USING (inst)""",
    "weak_signal_activities": SIGNALS + " SELECT inst, activity_id FROM sig WHERE weak",
    "speculative_activities": SIGNALS + " SELECT inst, activity_id FROM sig WHERE spec",
    "merged_chunk_institutions": MERGED + ", r AS (SELECT *, CASE verdict WHEN 'yes' THEN 2 WHEN 'unclear' THEN 1 ELSE 0 END AS r FROM chunk) SELECT inst, ['no', 'unclear', 'yes'][max(r) + 1] AS verdict, arg_max(summary, (r, n_rows, -chunk)) AS summary, count(*) AS n_chunks FROM r GROUP BY 1",
    "merged_chunk_activities": MERGED + ", c AS (SELECT inst, number, count(*) AS n_sources FROM kept GROUP BY 1, 2) SELECT inst, 'A' || number AS activity_id, activity_name, tool, vendor, ['low', 'medium', 'high'][c] AS confidence, CASE WHEN len(fl) = 0 THEN 'none' ELSE array_to_string(fl, ';') END AS flags, coalesce(n_sources, 0) AS n_sources FROM num LEFT JOIN c USING (inst, number)",
    "merged_chunk_sources": MERGED + " SELECT inst, 'S' || row_number() OVER (PARTITION BY inst ORDER BY chunk, pos, url, snippet) AS source_id, coalesce('A' || number, '_NA_') AS activity_id, url, snippet FROM kept",
    "verdict_rules_v25": _verdict(_OLD),
    "verdict_rules_v27": _verdict(_NEW),
    "link_rules_v25": _links("false"),
    "link_rules_v27": _links("coalesce(starts_with(support, 'downgraded_'), false)"),
    "declared_source_counts": PANEL + ", c AS (SELECT inst, activity_id, count(*) AS actual FROM src WHERE activity_id <> '_NA_' GROUP BY 1, 2) SELECT inst, activity_id, n_sources AS declared, coalesce(actual, 0) AS actual FROM act LEFT JOIN c USING (inst, activity_id) WHERE coalesce(actual, 0) = 0 OR n_sources <> actual",
    "metadata_differences": ctes(a=INSTITUTIONS, b=COPY) + ", u AS (SELECT a.inst, unnest(['name', 'country', 'level']) AS field, unnest([a.name, a.country, a.level]) AS left_value, unnest([b.name, b.country, b.level]) AS right_value FROM a JOIN b USING (inst)) SELECT * FROM u WHERE left_value IS DISTINCT FROM right_value",
    "envelope_links": PANEL + """, i AS (SELECT inst FROM inst WHERE inst % 19 <> 0) SELECT inst, 'activities' AS "table", activity_id AS id, 'unknown_institution' AS rule FROM act WHERE inst NOT IN (SELECT inst FROM i)
      UNION ALL SELECT inst, 'sources', source_id, 'unknown_institution' FROM src WHERE inst NOT IN (SELECT inst FROM i)
      UNION ALL SELECT inst, 'activities', activity_id, 'repeated_id' FROM act GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT inst, 'sources', source_id, 'repeated_id' FROM src GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT inst, 'sources', source_id, 'unknown_activity' FROM src s WHERE activity_id <> '_NA_' AND NOT EXISTS (SELECT 1 FROM act a WHERE a.inst = s.inst AND a.activity_id = s.activity_id)
      UNION ALL SELECT inst, 'activities', activity_id, 'no_source' FROM act a WHERE NOT EXISTS (SELECT 1 FROM src s WHERE a.inst = s.inst AND a.activity_id = s.activity_id)""",
    "document_status": "WITH s AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'held' WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 5 < 3 THEN 'unreadable' ELSE 'loaded' END AS status, o_orderstatus FROM orders) SELECT key, status, CASE WHEN status = 'loaded' THEN key END AS id, CASE WHEN status = 'loaded' THEN o_orderstatus END AS value FROM s",
    "review_depth": ctes(p=PAGES) + ", v AS (SELECT inst, channel, string_agg(verdict || ':' || n, ',' ORDER BY verdict) AS by_verdict FROM (SELECT inst, channel, verdict, count(*) AS n FROM p WHERE reviewed GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT p.inst, p.channel, count(*) FILTER (reviewed) AS n_reviewed, count(*) FILTER (failed) AS n_failed, count(*) FILTER (followed) AS n_followed, coalesce(any_value(by_verdict), '') AS by_verdict FROM p LEFT JOIN v ON v.inst = p.inst AND v.channel = p.channel GROUP BY 1, 2",
    "institution_verdicts": ctes(p=PAGES, a=TIERED) + """, f AS (SELECT inst, bool_and(reviewed AND NOT failed AND (verdict = 'no_genai' AND support = 'supported' OR verdict = 'not_assessable' AND support = 'set_by_rule')) AS clear, bool_or(reviewed AND verdict = 'no_genai') AS negative FROM p GROUP BY 1),
      t AS (SELECT inst, max(CASE WHEN action IN ('deployment', 'program') AND stage = 'pilot' THEN 4 WHEN stage = 'announced' OR purchase = 'tender_or_rfp' THEN 3 WHEN action = 'governance' THEN 2 WHEN stage = 'proposed' THEN 1 ELSE 0 END) AS r FROM a GROUP BY 1),
      v AS (SELECT coalesce(f.inst, t.inst) AS inst, CASE WHEN r IS NOT NULL THEN 'yes' WHEN clear AND negative THEN 'no' ELSE 'unclear' END AS verdict, r FROM f FULL JOIN t ON f.inst = t.inst)
      SELECT inst, verdict, CASE r WHEN 4 THEN 'documented_use' WHEN 3 THEN 'documented_commitment' WHEN 2 THEN 'governance_or_training_only' WHEN 1 THEN 'proposal_only' WHEN 0 THEN 'unclear' ELSE CASE verdict WHEN 'no' THEN 'none_found' ELSE 'unclear' END END AS tier FROM v""",
    "contact_answer": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_custkey % 4 = 0 THEN 'yes' WHEN o_orderkey % 3 = 1 AND o_custkey % 4 > 1 THEN 'no' ELSE 'unknown' END AS answer FROM orders",
    "ambiguous_stages": ctes(a=ACTIVITIES) + "SELECT inst, count(DISTINCT stage) FILTER (stage <> 'announced') > 1 AS ambiguous FROM a GROUP BY 1",
    "unanimous_dates": "WITH v AS (SELECT l_orderkey AS unit, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE CAST(l_suppkey % 3 AS VARCHAR) END AS v FROM lineitem) SELECT unit, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS value, CASE count(DISTINCT v) WHEN 0 THEN 'none' WHEN 1 THEN 'unanimous' ELSE 'ambiguous' END AS status FROM v GROUP BY 1",
    "supporting_sources": "WITH f AS (SELECT l_orderkey AS unit, 's' || (l_suppkey % 4) AS source, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2) SELECT unit, string_agg(source, '|' ORDER BY first, source) AS sources FROM f GROUP BY 1",
    "renumbered_sources": ctes(s=SOURCES) + "SELECT inst, source_id, 'S' || row_number() OVER (PARTITION BY inst ORDER BY pos, source_id) AS \"new\" FROM s",
}
ORACLES["source_rows"] = ORACLES["salvage_map"].replace("SELECT inst, url, array_to_string", ", m AS (SELECT inst, url, array_to_string", 1) + "), s AS (" + SOURCES.replace("{", "").replace("}", "") + ") SELECT 'run1::' || inst || '::' || source_id AS global_row_id, inst, source_id, activity_id, url, coalesce(fields, '') AS salvaged_fields FROM s LEFT JOIN m USING (inst, url)"
