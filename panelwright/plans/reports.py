"""Report queries: funnels, outcomes, cross-run diffs, statistics, cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import cost, diff, funnel
from ..session import table



def _events(spark, sf):
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _ledger(spark, sf):
    e = _events(spark, sf)
    return e.select(F.col("event_type").alias("stage"), F.when(F.col("k") % 7 == 0, "").otherwise(F.concat(F.lit("r"), (F.col("k") % 5).cast("string"))).alias("reason"))


LEDGER = "(SELECT event_type AS stage, CASE WHEN k % 7 = 0 THEN '' ELSE 'r' || (k % 5) END AS reason FROM ev)"
EV = "WITH ev AS (SELECT *, CAST(props->>'k' AS INTEGER) AS k FROM events) "


def funnel_health(spark, sf):
    return funnel.funnel(_events(spark, sf), "event_type", "user_id", F.col("value") >= 10, (0.55, 0.3), F.col("k") >= 50, (0.45, 0.6))


def attrition_counts(spark, sf):
    return funnel.reason_counts(_ledger(spark, sf))


def attrition_top_reasons(spark, sf):
    return funnel.top_reasons(_ledger(spark, sf), 15)


def _docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.withColumn("langs", F.when(F.col("doc_id") % 3 == 0, F.array("lang", F.lit("en"))).otherwise(F.array("lang")))


DOCS = "WITH d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN list_distinct([lang, 'en']) ELSE [lang] END AS langs FROM documents) "


def language_breakdown(spark, sf):
    return funnel.by_language(_docs(spark, sf), "langs", {"n": F.count(F.lit(1)), "n_long": F.count_if(F.col("n_chars") >= 2000), "chars": F.sum("n_chars"), "long_rate": stats.rate(F.count_if(F.col("n_chars") >= 2000), F.count(F.lit(1)))})


def detect_languages(spark, sf):
    return _docs(spark, sf).select(F.explode("langs").alias("language")).distinct()


def filter_shadow_recall(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = _docs(spark, sf).join(labels, "doc_id", "left").select("langs", F.when(F.col("n_chars") < 500, "drop").otherwise("pass").alias("decision"), (F.coalesce("quality", F.lit(0)) == 1).alias("kept"))
    return funnel.shadow_recall(d, "langs")


def language_readiness(spark, sf):
    d = language_breakdown(spark, sf).where("language <> '__total__'").select("language", F.col("long_rate").alias("rate"))
    return funnel.readiness(d, "en", 0.05, 0.3)


def run_status_counts(spark, sf):
    return funnel.status_counts(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")), "status", ["F", "O", "P", "X"])


def cumulative_completion(spark, sf):
    stages = ["view", "click", "signup", "purchase"]
    at = F.array_position(F.array(*map(F.lit, stages)), F.col("event_type"))
    reached = _events(spark, sf).groupBy("user_id").agg(F.max(at).alias("reached"))
    return reached.agg(*[F.count_if(F.col("reached") >= i + 1).alias(s) for i, s in enumerate(stages)])


def institution_outcomes(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), "o_orderstatus", "o_totalprice")
    return funnel.outcomes(c, {"orders": o, "finished": o.where("o_orderstatus = 'F'"), "large": o.where("o_orderstatus = 'F' AND o_totalprice > 400000")}, "cust")


def timing_summary(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = _events(spark, sf).select(F.col("event_type").alias("stage"), (F.col("k") % 10).alias("chunk"), F.floor(at / 3600).alias("start"), F.floor(at / 3600 + F.col("k") / 10).alias("end"))
    return cost.timing_summary(w)


def slowest_entities(spark, sf):
    return _events(spark, sf).groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("seconds")).orderBy(F.desc("seconds"), "user_id").limit(10)


# Cross-run diffs: runs are event types, institutions users modulo 40, members the k of the event.
def _members(spark, sf):
    return _events(spark, sf).select((F.col("user_id") % 40).alias("institution"), F.col("event_type").alias("run"), (F.col("k") % 12).alias("member"), F.when(F.col("value") >= 8, "keep").otherwise("drop").alias("decision"))


MEM = EV + ", m AS (SELECT user_id % 40 AS institution, event_type AS run, k % 12 AS member, CASE WHEN value >= 8 THEN 'keep' ELSE 'drop' END AS decision FROM ev), held AS (SELECT DISTINCT institution, run, member FROM m), inst AS (SELECT DISTINCT user_id % 40 AS institution FROM ev UNION SELECT 99) "
RUNS = ["click", "error", "purchase", "signup", "view"]


def _institutions(spark, sf):
    return _events(spark, sf).select((F.col("user_id") % 40).alias("institution")).distinct().union(spark.range(99, 100).toDF("institution"))


def run_diff_jaccard(spark, sf):
    return diff.nway_jaccard(_members(spark, sf), _institutions(spark, sf), 5)


def run_diff_pairwise(spark, sf):
    return diff.mean_pairwise_jaccard(_members(spark, sf), _institutions(spark, sf), RUNS)


def presence_histogram(spark, sf):
    return diff.presence_histogram(_members(spark, sf))


def flip_rate(spark, sf):
    return diff.flips(_members(spark, sf), 5)


def run_deltas(spark, sf):
    return diff.deltas(_members(spark, sf), "click")


def run_completeness(spark, sf):
    return diff.completeness(_members(spark, sf).select("institution", "run", F.concat(F.lit("a"), F.col("member").cast("string")).alias("artifact"), F.col("member").alias("size")))


def most_diverged_stage(spark, sf):
    s = run_deltas(spark, sf).groupBy("run").agg(F.count(F.lit(1)).alias("n_diverged")).select(F.col("run").alias("stage"), F.length("run").alias("position"), "n_diverged")
    return diff.most_diverged(s)


# Statistics
def _arms(spark, sf):
    return table(spark, sf, "labels").groupBy().agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("both"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("only_a"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("only_b"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("neither"))


ARMS = "WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS \"both\", count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b, count(*) FILTER (quality = 0 AND toxic = 0) AS neither FROM labels) "


def table_2x2(spark, sf):
    return _arms(spark, sf)


def cohen_kappa(spark, sf):
    return _arms(spark, sf).select(F.round(stats.kappa(F.col("both"), F.col("only_a"), F.col("only_b"), F.col("neither")), 6).alias("kappa"))


def mcnemar_exact(spark, sf):
    e = _events(spark, sf).groupBy("user_id").agg(F.max((F.col("event_type") == "click").cast("int")).alias("a"), F.max(((F.col("event_type") == "signup") & (F.col("k") < 50)).cast("int")).alias("b"))
    t = e.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("gains"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("losses"))
    return t.withColumn("p", F.round(stats.mcnemar_exact(F.col("gains"), F.col("losses")), 8))


def wilson_interval(spark, sf):
    e = _events(spark, sf).groupBy("event_type").agg(F.count_if(F.col("value") >= 10).alias("k"), F.count(F.lit(1)).alias("n"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return e.select("event_type", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


def threshold_sweep(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("t", F.explode(F.array(*[F.lit(t) for t in range(500, 5001, 500)])))
    return d.groupBy("t").agg(F.count_if((F.col("n_chars") >= F.col("t")) & (F.col("quality") == 0)).alias("false_pos"), F.count_if((F.col("n_chars") < F.col("t")) & (F.col("quality") == 1)).alias("false_neg"))


def spearman_ties(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("x"), F.max(F.month("o_orderdate")).alias("y"))
    rx, ry = (stats.mean_ranks(o, c).withColumnRenamed("rank", f"r{c}") for c in ("x", "y"))
    return o.join(rx, "x").join(ry, "y").agg(F.round(F.corr("rx", "ry"), 6).alias("rho"))


def pearson(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


def nearest_rank(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(*[F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY n_chars) AS BIGINT)").alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))])


def expected_score(spark, sf):
    e = _events(spark, sf)
    p = F.array(*[((F.col("k") + i * 7) % 11 + 1).cast("double") for i in range(1, 6)])
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return e.select("event_id", F.array_position(p, F.array_max(p)).cast("int").alias("argmax"), F.round(F.aggregate(F.transform(p, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x) / total, 6).alias("expected"))


# Cost
RATES = {"input": 1.25, "cached": 0.31, "output": 10.0, "input_high": 2.5, "cached_high": 0.625, "output_high": 15.0}


def tiered_cost(spark, sf):
    li = table(spark, sf, "lineitem")
    prompt = (F.col("l_quantity") * 6000).cast("long")
    usd = cost.tiered_usd(prompt, (prompt * F.col("l_discount")).cast("long"), F.col("l_linenumber") * 500, RATES)
    return li.groupBy("l_returnflag").agg(F.round(F.sum(usd), 2).alias("usd"), F.count_if(prompt > 200_000).alias("n_high"))


def priced_totals(spark, sf):
    usage = _events(spark, sf).select(F.col("event_type").alias("stage"), F.concat(F.lit("m"), (F.col("user_id") % F.when(F.col("event_type") == "error", 4).otherwise(3)).cast("string")).alias("model"), (F.col("k") * 1.0).alias("units"))
    prices = spark.sql("SELECT * FROM VALUES ('m0', 0.5D), ('m1', 0.25D), ('m2', 2.0D) AS t(model, price)")
    return cost.priced_totals(usage, prices, "stage")


def project_modes(spark, sf):
    per = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 2).alias("per_unit"))
    return per.select("c_mktsegment", F.explode(cost.project_modes(F.col("per_unit"), 1000, {"live": 1.0, "batch": 0.5, "mix": 0.75})).alias("mode", "usd"))


def projection_check(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count_distinct("o_orderstatus").alias("stages"))
    return o.select("o_orderpriority", cost.within_projection(F.col("spent"), F.lit(1.5e9), F.lit(1e8), 8e8, F.col("stages")).alias("within"))


QUERIES = {f.__name__: f for f in (funnel_health, attrition_counts, attrition_top_reasons, language_breakdown, detect_languages, filter_shadow_recall, language_readiness, run_status_counts, cumulative_completion, institution_outcomes, timing_summary, slowest_entities, run_diff_jaccard, run_diff_pairwise, presence_histogram, flip_rate, run_deltas, run_completeness, most_diverged_stage, table_2x2, cohen_kappa, mcnemar_exact, wilson_interval, threshold_sweep, spearman_ties, pearson, nearest_rank, expected_score, tiered_cost, priced_totals, project_modes, projection_check)}

_BY_LANG = DOCS + ", e AS (SELECT unnest(langs) AS language, d.* FROM d UNION ALL BY NAME SELECT '__total__' AS language, d.* FROM d) "
ORACLES = {
    "funnel_health": EV + """, a AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_entities, count(*) FILTER (value >= 10) AS n_passed, count(*) FILTER (k >= 50) AS n_bad FROM ev GROUP BY 1),
      r AS (SELECT *, round(n_passed / n, 4) AS pass_rate, round(n_bad / n, 4) AS bad_rate FROM a),
      f AS (SELECT *, CASE WHEN pass_rate <= 0.3 THEN 'fail' WHEN pass_rate <= 0.55 THEN 'warn' ELSE 'green' END AS pass_flag, CASE WHEN bad_rate >= 0.6 THEN 'fail' WHEN bad_rate >= 0.45 THEN 'warn' ELSE 'green' END AS bad_flag FROM r)
      SELECT *, CASE WHEN 'fail' IN (pass_flag, bad_flag) THEN 'fail' WHEN 'warn' IN (pass_flag, bad_flag) THEN 'warn' ELSE 'green' END AS flag FROM f""",
    "attrition_counts": EV + f"SELECT stage, reason, count(*) AS n FROM {LEDGER} WHERE reason <> '' GROUP BY 1, 2",
    "attrition_top_reasons": EV + f"SELECT stage, reason, count(*) AS n FROM {LEDGER} WHERE reason <> '' GROUP BY 1, 2 ORDER BY n DESC, stage, reason LIMIT 15",
    "language_breakdown": _BY_LANG + "SELECT language, count(*) AS n, count(*) FILTER (n_chars >= 2000) AS n_long, CAST(sum(n_chars) AS BIGINT) AS chars, round(count(*) FILTER (n_chars >= 2000) / count(*), 4) AS long_rate FROM e GROUP BY 1",
    "detect_languages": DOCS + "SELECT DISTINCT unnest(langs) AS language FROM d",
    "filter_shadow_recall": "WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1), d AS (SELECT CASE WHEN doc_id % 3 = 0 THEN list_distinct([lang, 'en']) ELSE [lang] END AS langs, n_chars >= 500 AS pass, coalesce(quality, 0) = 1 AS kept FROM documents LEFT JOIN l USING (doc_id)), e AS (SELECT unnest(langs) AS language, pass, kept FROM d UNION ALL SELECT '__total__', pass, kept FROM d) SELECT language, count(*) AS n, count(*) FILTER (pass) AS n_pass, count(*) FILTER (kept) AS n_kept, round(count(*) FILTER (kept AND pass) / nullif(count(*) FILTER (kept), 0), 4) AS shadow_recall FROM e GROUP BY 1",
    "language_readiness": DOCS + ", e AS (SELECT unnest(langs) AS language, n_chars FROM d), r AS (SELECT language, round(count(*) FILTER (n_chars >= 2000) / count(*), 4) AS rate FROM e GROUP BY 1) SELECT language, rate, rate >= (SELECT rate FROM r WHERE language = 'en') - 0.05 AND rate >= 0.3 AS ready FROM r",
    "run_status_counts": "SELECT status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders ON o_orderstatus = status GROUP BY 1",
    "cumulative_completion": "WITH r AS (SELECT user_id, max(list_position(['view', 'click', 'signup', 'purchase'], event_type)) AS reached FROM events GROUP BY 1) SELECT count(*) FILTER (reached >= 1) AS view, count(*) FILTER (reached >= 2) AS click, count(*) FILTER (reached >= 3) AS signup, count(*) FILTER (reached >= 4) AS purchase FROM r",
    "institution_outcomes": "WITH a AS (SELECT c_custkey AS cust, count(o_orderkey) AS n_orders, count(*) FILTER (o_orderstatus = 'F') AS n_finished, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 400000) AS n_large FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT *, CASE WHEN n_orders = 0 THEN 'no_orders' WHEN n_finished = 0 THEN 'no_finished' WHEN n_large = 0 THEN 'no_large' ELSE 'complete' END AS final_status FROM a",
    "timing_summary": EV + ", w AS (SELECT DISTINCT event_type AS stage, k % 10 AS chunk, floor(epoch_us(ts) / 1e6 / 3600) AS s, floor(epoch_us(ts) / 1e6 / 3600 + k / 10) AS e FROM ev) SELECT stage, CAST(sum(e - s) AS BIGINT) AS work_s, CAST(max(e) - min(s) AS BIGINT) AS wall_s, count(*) AS n FROM w GROUP BY 1",
    "slowest_entities": "SELECT user_id, round(sum(value), 2) AS seconds FROM events GROUP BY 1 ORDER BY seconds DESC, user_id LIMIT 10",
    "run_diff_jaccard": MEM + ", p AS (SELECT institution, member, count(*) AS n_runs FROM held GROUP BY 1, 2), a AS (SELECT institution, count(*) AS n_union, count(*) FILTER (n_runs = 5) AS n_common FROM p GROUP BY 1) SELECT institution, coalesce(n_union, 0) AS n_union, coalesce(n_common, 0) AS n_common, coalesce(round(n_common / nullif(n_union, 0), 4), 1.0) AS overlap FROM inst LEFT JOIN a USING (institution)",
    "run_diff_pairwise": MEM + ", r AS (SELECT DISTINCT run FROM held), n AS (SELECT institution, run, count(member) AS n FROM inst CROSS JOIN r LEFT JOIN held USING (institution, run) GROUP BY 1, 2), c AS (SELECT x.institution, x.run AS r1, y.run AS r2, count(*) AS c FROM held x JOIN held y USING (institution, member) WHERE x.run < y.run GROUP BY 1, 2, 3), p AS (SELECT a.institution, coalesce(coalesce(c, 0) / nullif(a.n + b.n - coalesce(c, 0), 0), 1.0) AS j FROM n a JOIN n b ON a.institution = b.institution AND a.run < b.run LEFT JOIN c ON c.institution = a.institution AND r1 = a.run AND r2 = b.run) SELECT institution, round(avg(j), 4) AS mean_overlap FROM p GROUP BY 1",
    "presence_histogram": MEM + ", p AS (SELECT institution, member, count(*) AS n_runs FROM held GROUP BY 1, 2) SELECT n_runs, count(*) AS n_members FROM p GROUP BY 1",
    "flip_rate": MEM + ", o AS (SELECT institution, run, member, min(CASE decision WHEN 'keep' THEN 0 ELSE 1 END) AS d FROM m GROUP BY 1, 2, 3), e AS (SELECT institution, member, min(d) AS lo, max(d) AS hi FROM o GROUP BY 1, 2 HAVING count(*) = 5) SELECT institution, count(*) AS n_common, count(*) FILTER (lo <> hi) AS n_flipped, round(count(*) FILTER (lo <> hi) / count(*), 4) AS flip_rate FROM e GROUP BY 1",
    "run_deltas": MEM + ", b AS (SELECT institution, member FROM held WHERE run = 'click'), r AS (SELECT DISTINCT institution, run FROM held WHERE run <> 'click'), o AS (SELECT h.institution, h.run, count(*) AS n_only FROM held h LEFT JOIN b ON b.institution = h.institution AND b.member = h.member WHERE run <> 'click' AND b.member IS NULL GROUP BY 1, 2), s AS (SELECT r.institution, r.run, count(*) AS n_missing FROM r JOIN b USING (institution) LEFT JOIN held h ON h.institution = r.institution AND h.run = r.run AND h.member = b.member WHERE h.member IS NULL GROUP BY 1, 2) SELECT institution, run, coalesce(n_only, 0) AS n_only, coalesce(n_missing, 0) AS n_missing FROM o FULL JOIN s USING (institution, run)",
    "run_completeness": MEM + "SELECT run, 'a' || member AS artifact, count(DISTINCT institution) AS n FROM m WHERE member > 0 GROUP BY 1, 2",
    "table_2x2": ARMS + "SELECT * FROM t",
    "cohen_kappa": ARMS + ", k AS (SELECT (\"both\" + neither) / (\"both\" + only_a + only_b + neither) AS po, ((\"both\" + only_a) * (\"both\" + only_b) + (neither + only_b) * (neither + only_a)) / ((\"both\" + only_a + only_b + neither) * (\"both\" + only_a + only_b + neither)) AS pe FROM t) SELECT round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM k",
    "mcnemar_exact": EV + """, e AS (SELECT user_id, max(CAST(event_type = 'click' AS INT)) AS a, max(CAST(event_type = 'signup' AND k < 50 AS INT)) AS b FROM ev GROUP BY 1),
      t AS (SELECT count(*) FILTER (a = 1 AND b = 0) AS gains, count(*) FILTER (a = 0 AND b = 1) AS losses FROM e)
      SELECT gains, losses, round(least(1.0, 2 * (SELECT sum(exp(lgamma(gains + losses + 1) - lgamma(i + 1) - lgamma(gains + losses - i + 1) - (gains + losses) * ln(2.0))) FROM range(0, least(gains, losses) + 1) r(i))), 8) AS p FROM t""",
    "wilson_interval": "WITH e AS (SELECT event_type, count(*) FILTER (value >= 10) AS k, count(*) AS n FROM events GROUP BY 1), w AS (SELECT event_type, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS c, 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS h FROM e) SELECT event_type, round(c - h, 6) AS low, round(c + h, 6) AS high FROM w",
    "threshold_sweep": "SELECT CAST(t AS INTEGER) AS t, count(*) FILTER (n_chars >= t AND quality = 0) AS false_pos, count(*) FILTER (n_chars < t AND quality = 1) AS false_neg FROM documents JOIN labels USING (doc_id) CROSS JOIN range(500, 5001, 500) r(t) GROUP BY 1",
    "spearman_ties": "WITH o AS (SELECT o_custkey, count(*) AS x, max(month(o_orderdate)) AS y FROM orders GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM o) SELECT round(corr(rx, ry), 6) AS rho FROM r",
    "pearson": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem",
    "nearest_rank": "SELECT lang, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.99) AS p99 FROM documents GROUP BY 1",
    "expected_score": EV + ", p AS (SELECT event_id, [CAST((k + i * 7) % 11 + 1 AS DOUBLE) FOR i IN range(1, 6)] AS p FROM ev) SELECT event_id, CAST(list_position(p, list_max(p)) AS INTEGER) AS argmax, round((p[1] + 2 * p[2] + 3 * p[3] + 4 * p[4] + 5 * p[5]) / list_sum(p), 6) AS expected FROM p",
    "tiered_cost": "WITH u AS (SELECT l_returnflag, CAST(floor(l_quantity * 6000) AS BIGINT) AS prompt, CAST(floor(CAST(floor(l_quantity * 6000) AS BIGINT) * l_discount) AS BIGINT) AS cached, l_linenumber * 500 AS completion FROM lineitem) SELECT l_returnflag, round(sum(CASE WHEN prompt > 200000 THEN (prompt - cached) * 2.5 + cached * 0.625 + completion * 15.0 ELSE (prompt - cached) * 1.25 + cached * 0.31 + completion * 10.0 END / 1e6), 2) AS usd, count(*) FILTER (prompt > 200000) AS n_high FROM u GROUP BY 1",
    "priced_totals": EV + ", u AS (SELECT event_type AS stage, 'm' || (user_id % CASE event_type WHEN 'error' THEN 4 ELSE 3 END) AS model, CAST(k AS DOUBLE) AS units FROM ev) SELECT stage, CASE WHEN count(*) FILTER (price IS NULL) > 0 THEN NULL ELSE round(sum(units * price), 4) END AS usd FROM u LEFT JOIN (VALUES ('m0', 0.5::DOUBLE), ('m1', 0.25::DOUBLE), ('m2', 2.0::DOUBLE)) p(model, price) USING (model) GROUP BY 1",
    "project_modes": "WITH p AS (SELECT c_mktsegment, round(avg(c_acctbal), 2) AS per_unit FROM customer GROUP BY 1) SELECT c_mktsegment, mode, round(per_unit * 1000 * f, 2) AS usd FROM p CROSS JOIN (VALUES ('live', 1.0::DOUBLE), ('batch', 0.5::DOUBLE), ('mix', 0.75::DOUBLE)) m(mode, f)",
    "projection_check": "WITH o AS (SELECT o_orderpriority, round(sum(o_totalprice), 2) AS spent, count(DISTINCT o_orderstatus) AS stages FROM orders GROUP BY 1) SELECT o_orderpriority, stages < 2 OR spent + least(greatest(spent / 1.5e9, 0.5), 3.0) * 1e8 <= 8e8 * 1.25 AS within FROM o",
}
ORACLES["most_diverged_stage"] = ORACLES["run_deltas"].replace("SELECT institution, run, coalesce(n_only, 0)", ", z AS (SELECT institution, run, coalesce(n_only, 0)") + "), q AS (SELECT run AS stage, length(run) AS position, count(*) AS n_diverged FROM z GROUP BY 1) SELECT stage, n_diverged FROM q ORDER BY n_diverged DESC, position LIMIT 1"
