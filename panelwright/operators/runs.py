"""Run records: reconciling plans with results, resuming, journals, usage, languages, links, quotes and pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut


class WrongLayout(ValueError):
    """A run was written under another layout version."""


def require_layout(manifests: DataFrame, version: int) -> DataFrame:
    """The manifests, unless any (or a missing version) is of another layout."""
    other = manifests.where(~F.col("layout_version").eqNullSafe(F.lit(version))).limit(5).collect()
    if other:
        raise WrongLayout(f"layout of {[r['run_id'] for r in other]} is not {version}")
    return manifests


def uid_map(manifests: DataFrame) -> DataFrame:
    """(run_id, institution_id, uid) from the map in each manifest."""
    return manifests.select("run_id", F.explode("uids").alias("institution_id", "uid"))


def latest_version(files: DataFrame) -> DataFrame:
    """(run_id, version, files): of paths named name_vN.csv the set of the highest N per run."""
    placed = files.withColumn("version", F.regexp_extract("path", r"_v([0-9]+)\.csv$", 1).try_cast("int")).where("version IS NOT NULL")
    sets = placed.groupBy("run_id", "version").agg(F.array_join(F.array_sort(F.collect_set("path")), "|").alias("files"))
    best = sets.groupBy("run_id").agg(F.max(F.struct("version", "files")).alias("best_"))
    return best.select("run_id", "best_.version", "best_.files")


def institution_keys(rows: DataFrame) -> DataFrame:
    """(key, key_column): distinct institution keys, the uid where a row has one, else the id."""
    key = F.coalesce(F.nullif("uid", F.lit("")), F.nullif("id", F.lit("")))
    return rows.select(key.alias("key"), F.when(F.nullif("uid", F.lit("")).isNotNull(), "uid").otherwise("id").alias("key_column")).where("key IS NOT NULL").distinct()


def reconcile(planned: DataFrame, observed: DataFrame, key: str = "custom_id") -> DataFrame:
    """(key, status): missing, extra or duplicate between a plan and what came back."""
    p = planned.select(key).distinct().withColumn("planned", F.lit(True))
    o = observed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    met = p.join(o, key, "full")
    found = F.array_compact(F.array(F.when(F.col("n").isNull(), "missing"), F.when(F.col("planned").isNull(), "extra"), F.when(F.col("n") > 1, "duplicate")))
    return met.select(key, F.explode(found).alias("status"))


def both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, columns): rows of one table that the other lacks, as multisets."""
    a, b = left.exceptAll(right), right.exceptAll(left)
    return a.select(F.lit("left").alias("side"), *left.columns).union(b.select(F.lit("right"), *left.columns))


def same_sequence(left: DataFrame, right: DataFrame, position: str, value: str) -> DataFrame:
    """(position, left_value, right_value): places at which two ordered tables differ; none if they are the same sequence."""
    a, b = left.select(position, F.col(value).alias("left_value")), right.select(position, F.col(value).alias("right_value"))
    return a.join(b, position, "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def pruned(records: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Records but for those whose key was dropped for their institution; a key that was also kept stays."""
    dropped = decisions.groupBy(*keys).agg(F.bool_and(F.col("decision") == "drop").alias("gone")).where("gone").select(*keys)
    return records.join(dropped, keys, "left_anti")


def needs_fallback(sample: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """The institutions of the sample without an official site."""
    return sample.join(sites.where(F.nullif(F.trim("url"), F.lit("")).isNotNull()).select(key), key, "left_anti")


def still_needed(tasks: DataFrame, answered: DataFrame, keys: list[str], rejected: Column) -> DataFrame:
    """Tasks without an answer, with why (rejected) they will not be asked, null where they will."""
    return tasks.join(answered.select(*keys).distinct(), keys, "left_anti").withColumn("rejected", rejected)


def status_tallies(statuses: DataFrame) -> DataFrame:
    """(run_id, code, n, divergent): counts per run and code, and of how many of these institutions the runs disagree."""
    apart = statuses.groupBy("institution").agg((F.count_distinct("code") > 1).alias("apart"))
    return statuses.join(apart, "institution").groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("n"), F.count_if("apart").alias("divergent"))


def usage_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, tokens): totals of journaled calls; a request that was replayed counts once."""
    return calls.groupBy(*by, "request").agg(F.max("tokens").alias("tokens")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


def last_seq(events: DataFrame) -> DataFrame:
    """(run_id, last_seq, elapsed): the highest sequence number and the time from the first to the last event."""
    return events.groupBy("run_id").agg(F.max("seq").alias("last_seq"), (F.max("at") - F.min("at")).alias("elapsed"))


def with_seq(events: DataFrame, known: DataFrame) -> DataFrame:
    """New events numbered on from each run's last sequence number, in order of time; known (run_id, last_seq).

    A run's batch is numbered in one sorted array, so it is a batch of one
    run's new events that has to fit, not its log.
    """
    batch = events.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("at", "event"))).alias("new_")).join(known, "run_id", "left")
    each = batch.select("run_id", "last_seq", F.posexplode("new_").alias("place_", "one_"))
    return each.select("run_id", (F.coalesce("last_seq", F.lit(0)) + F.col("place_") + 1).alias("seq"), "one_.at", "one_.event")


def journal_state(journal: DataFrame) -> DataFrame:
    """(request, state): intent, submitted, collected or abandoned; the furthest state counts, abandoned only before collection."""
    has = lambda s: F.bool_or(F.col("event") == s)
    state = F.when(has("collected"), "collected").when(has("abandoned"), "abandoned").when(has("submitted"), "submitted").otherwise("intent")
    return journal.groupBy("request").agg(state.alias("state"))


def replayed(requests: DataFrame, journal: DataFrame) -> DataFrame:
    """Requests with the response that the journal holds for the same content; those without one are to be sent.

    Of several stored responses the first counts, so the same request always has the same response.
    """
    stored = journal.where("response IS NOT NULL").groupBy("digest").agg(F.min_by("response", "seq").alias("response"))
    asked = requests.withColumn("digest", F.sha2("body", 256))
    return asked.join(stored, "digest", "left").select(*requests.columns, "response", F.col("response").isNull().alias("to_send"))


def chunk_estimate(jobs: Column, bytes_per_job: Column, most_bytes: int, most_jobs: int) -> Column:
    """Chunks needed for so many jobs: by bytes or by number, whichever is more."""
    return F.greatest(F.ceil(jobs * bytes_per_job / most_bytes), F.ceil(jobs / most_jobs))


def waves(state: DataFrame, step, most: int = 50) -> tuple[DataFrame, int]:
    """(state, rounds): step(state) until it brings no new row, ``most`` rounds at the outside; each round's rows are cut from their lineage."""
    state = cut(state.distinct())
    count, rounds = state.count(), 0
    while rounds < most:
        rounds += 1
        state = cut(state.union(step(state).select(*state.columns)).distinct())
        now = state.count()
        if now == count:
            return state, rounds
        count = now
    raise RuntimeError(f"no fixpoint after {most} rounds")


def gate_faults(items: DataFrame) -> DataFrame:
    """(item, fault): gates to an item that does not exist, that are not after their target, or that run in a circle; items (item, gate, pass, round)."""
    target = items.select(F.col("item").alias("gate"), F.col("pass").alias("t_pass"), F.col("round").alias("t_round"), F.lit(True).alias("exists"))
    met = items.where("gate IS NOT NULL").join(target, "gate", "left")
    early = (F.col("pass") < F.col("t_pass")) | ((F.col("pass") == F.col("t_pass")) & (F.col("round") <= F.col("t_round")))
    faults = met.select("item", F.when(F.col("exists").isNull(), "unknown_gate").when(early, "not_after_gate").alias("fault")).where("fault IS NOT NULL")
    edges = items.where("gate IS NOT NULL").select(F.col("item").alias("a"), F.col("gate").alias("b"))
    reach, _ = waves(edges, lambda s: s.alias("s").join(edges.alias("e"), F.col("s.b") == F.col("e.a")).select(F.col("s.a").alias("a"), F.col("e.b").alias("b")))
    return faults.union(reach.where("a = b").select(F.col("a").alias("item"), F.lit("circle").alias("fault")))


def vocabulary_faults(values: DataFrame, missing: tuple[str, ...]) -> DataFrame:
    """(item, value, fault): values that repeat, are not snake_case, or are a missing token."""
    counted = values.groupBy("item", "value").agg(F.count(F.lit(1)).alias("n"))
    faults = F.array_compact(F.array(F.when(F.col("n") > 1, "repeated"), F.when(~F.col("value").rlike("^[a-z0-9]+(_[a-z0-9]+)*$"), "not_snake_case"), F.when(F.col("value").isin(*missing), "missing_token")))
    return counted.select("item", "value", F.explode(faults).alias("fault"))


def id_changes(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, fault): ids that repeat now, or that the previous release had and this one lacks."""
    gone = previous.select(key).distinct().join(current.select(key), key, "left_anti").select(key, F.lit("removed").alias("fault"))
    return gone.union(current.groupBy(key).count().where("count > 1").select(key, F.lit("repeated").alias("fault")))


def typed_violations(values: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, item, fault): values that break their item's rule; rules (item, kind, codes): kind is code, integer, year or text."""
    met = values.join(rules, "item", "left")
    v = F.col("value")
    bad = (
        F.when(F.col("kind").isNull(), "unknown_item")
        .when((F.col("kind") == "code") & ~F.coalesce(F.array_contains("codes", v), F.lit(False)), "not_a_code")
        .when((F.col("kind") == "integer") & v.try_cast("long").isNull(), "not_a_number")
        .when((F.col("kind") == "year") & ~F.coalesce(v.rlike("^(19|20)[0-9]{2}$"), F.lit(False)), "not_a_year")
        .when((F.col("kind") == "text") & (F.trim(F.coalesce(v, F.lit(""))) == ""), "empty")
    )
    return met.select("key", "item", bad.alias("fault")).where("fault IS NOT NULL")


def stored_flags(flags: Column) -> Column:
    """A list of flags as the stored string: ';'-joined, 'none' where it is empty or null."""
    return F.coalesce(F.nullif(F.array_join(flags, ";"), F.lit("")), F.lit("none"))


def overridden(rows: DataFrame, when: Column, column: str, value: str, stages: tuple[str, ...]) -> DataFrame:
    """One item set by another: where the condition holds and the item has one of the stages, it becomes the value."""
    return rows.withColumn(column, F.when(when & F.col(column).isin(*stages), value).otherwise(F.col(column)))


def record_languages(found_by: Column, language: Column) -> Column:
    """Sorted languages that found a record: those of found_by where it names any query, else its one language."""
    many = F.array_sort(F.array_distinct(F.filter(F.transform(found_by, lambda f: f["language"]), lambda x: F.nullif(x, F.lit("")).isNotNull())))
    one = F.array_compact(F.array(F.nullif(language, F.lit(""))))
    return F.when(F.size(F.coalesce(found_by, F.array())) > 0, many).otherwise(one)


def policy_languages(rows: DataFrame, policy: DataFrame, fallback: list[str], always: list[str], key: str = "country") -> DataFrame:
    """The rows with languages and used_fallback: the policy's for their country, else the fallback; the always-included come first, each once."""
    met = rows.join(policy.select(key, F.col("languages").alias("mapped_")), key, "left")
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return met.withColumn("languages", F.array_distinct(F.concat(texts(always), F.coalesce("mapped_", texts(fallback))))).withColumn("used_fallback", F.col("mapped_").isNull()).drop("mapped_")


def languages_string(languages: Column, first: str | None = None) -> Column:
    """Distinct languages in order as one string, the domain query's first where there is one; null where none is left."""
    every = F.concat(F.array(F.lit(first)), languages) if first else languages
    return F.nullif(F.array_join(F.array_distinct(every), ","), F.lit(""))


def queries_by_language(institutions: DataFrame, roster: DataFrame, name: str, quoted: bool = False) -> DataFrame:
    """(key, language, query): one query per institution language that the roster has terms for; institutions (key, name, languages), roster (language, terms)."""
    each = institutions.select("key", F.col(name).alias("name_"), F.explode(F.array_distinct("languages")).alias("language")).join(roster, "language")
    bare = F.trim(F.regexp_replace(F.col("name_"), '"', ""))
    return each.select("key", "language", F.concat_ws(" ", F.concat(F.lit('"'), bare, F.lit('"')) if quoted else bare, F.nullif("terms", F.lit(""))).alias("query"))


def priced_models(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, base, price): the price of the model itself, else of the model that it is a dated snapshot of; null where neither is known."""
    both = models.select("model", F.col("model").alias("base"), F.lit(0).alias("away")).union(models.select("model", F.regexp_replace("model", r"-\d{4}-\d{2}-\d{2}$", ""), F.lit(1)))
    best = both.join(prices.select(F.col("model").alias("base"), "price"), "base").groupBy("model").agg(F.min(F.struct("away", "base", "price")).alias("best_"))
    return models.select("model").distinct().join(best, "model", "left").select("model", "best_.base", "best_.price")


def counts_from_log(text: Column, patterns: dict[str, str]) -> Column:
    """A struct of counts read from a log by named patterns with one group; thousands commas go, a number that is not there is null."""
    return F.struct(*[F.replace(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("long").alias(n) for n, p in patterns.items()])


def stage_as_of(published: Column, stated_year: Column, accessed: Column) -> Column:
    """The date of an observation: published, else a stated year that is not after the access year, else accessed."""
    year = F.when(stated_year.try_cast("int") <= F.substring(accessed, 1, 4).try_cast("int"), stated_year)
    return F.coalesce(published, year, accessed)


def is_future_year(year: Column, accessed: Column) -> Column:
    return year.try_cast("int") > F.substring(accessed, 1, 4).try_cast("int")


def instant(value: Column) -> Column:
    """An ISO instant with Z or an offset; null for anything else."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(value))


def located(quote: Column, text: Column) -> Column:
    """struct(start, end) of a quote in a text, from 0: as it stands, else in any case and with any white space; null where it is not there."""
    exact = F.instr(text, quote)
    words = F.filter(F.split(quote, r"\s+"), lambda w: w != "")
    pattern = F.concat(F.lit("(?isu)"), F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([\\\[\](){}.*+?^$|\-#&~])", r"\\$1")), r"\s+"))
    loose = F.when(F.size(words) > 0, F.nullif(F.regexp_substr(text, pattern), F.lit("")))
    start = F.when(exact > 0, exact).otherwise(F.instr(text, loose))
    return F.when((F.length(quote) > 0) & (start > 0), F.struct((start - 1).alias("start"), (start - 1 + F.when(exact > 0, F.length(quote)).otherwise(F.length(loose))).alias("end")))


def anchored_span(text: Column, first: Column, last: Column) -> Column:
    """struct(start, end, status): from where ``first`` stands to the end of the first ``last`` at or after it."""
    start = F.instr(text, first)
    after = F.instr(F.substring(text, start, F.length(text)), last)
    status = F.when((start == 0) | (F.length(first) == 0), "start_not_found").when((after == 0) | (F.length(last) == 0), "end_not_found").otherwise("found")
    found = status == "found"
    return F.struct(F.when(found, start - 1).alias("start"), F.when(found, start - 1 + after - 1 + F.length(last)).alias("end"), status.alias("status"))


def nearness(links: DataFrame, quotes: DataFrame, page: str = "page") -> DataFrame:
    """(page, link, gap): the least distance between a link's span and any quote's span on its page, 0 where they overlap; null where a page has no quote.

    The nearest quote that ends before a span and the nearest that starts
    after it decide, so spans are ordered once instead of paired: each link is
    looked up in its page's running extremes.
    """
    spans = links.select(page, F.col("link"), F.col("start").alias("at"), F.col("end").alias("till"), F.lit(1).alias("kind")).union(
        quotes.select(page, F.lit(None).cast(links.schema["link"].dataType), "start", "end", F.lit(0))
    )
    quote = F.col("kind") == 0
    before = Window.partitionBy(page).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(page).orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    reached = F.max(F.when(quote, F.col("till"))).over(before)
    coming = F.min(F.when(quote, F.col("at"))).over(after)
    room = lambda d: F.when(d.isNotNull(), F.greatest(d, F.lit(0)))
    gap = F.least(room(F.col("at") - reached), room(coming - F.col("till")))
    return spans.withColumn("gap", gap).where("kind = 1").select(page, "link", "gap")


def span_pairs(spans: DataFrame, page: str = "page") -> DataFrame:
    """(page, a, b, status): pairs of a page's spans by start, a before b; equal starts leave the order unresolved (a by id)."""
    a = spans.select(page, F.col("id").alias("a"), F.col("start").alias("a_start"))
    b = spans.select(page, F.col("id").alias("b"), F.col("start").alias("b_start"))
    met = a.join(b, page).where((F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col("a") < F.col("b"))))
    return met.select(page, "a", "b", F.when(F.col("a_start") == F.col("b_start"), "unresolved").otherwise("ordered").alias("status"))


def pool_order(undated: str = "last") -> list[Column]:
    """Sort order of pool entries: by date, page order and id, undated ones first or last."""
    if undated not in ("first", "last"):
        raise ValueError("undated must be 'first' or 'last'")
    date = F.nullif("source_date", F.lit(""))
    return [date.asc_nulls_last() if undated == "last" else date.asc_nulls_first(), F.col("page_order").asc(), F.col("entry_id").asc()]


def in_pool_order(entries: DataFrame, undated: str = "last", pool: str = "pool") -> DataFrame:
    """Entries with their position in the pool."""
    return entries.withColumn("position", F.row_number().over(Window.partitionBy(pool).orderBy(*pool_order(undated))))


def work_list(urls: DataFrame, most: int, key: str = "institution") -> DataFrame:
    """(key, urls): what is to be fetched for each institution, distinct URLs at their first rank, at most ``most`` (the budget)."""
    first = urls.groupBy(key, "url").agg(F.min("rank").alias("rank"))
    return first.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "url"))), 1, most), lambda s: s["url"]).alias("urls"))


def bypass_sites(overlay: DataFrame, least: int = 2, unshared: bool = True) -> DataFrame:
    """(uid, site, reason): the official site of each overlay row, or why it is skipped: below_confidence, shared_host or unusable."""
    rank = F.when(F.lower(F.trim("confidence")) == "high", 3).when(F.lower(F.trim("confidence")) == "medium", 2).when(F.lower(F.trim("confidence")) == "low", 1).otherwise(0)
    root = F.nullif(F.trim("site_root"), F.lit(""))
    no_uid = F.coalesce(F.trim("uid"), F.lit("")) == ""
    reason = F.when(no_uid, "unusable").when(rank < least, "below_confidence").when(root.isNull(), "unusable").when(F.lit(unshared) & (F.coalesce("n_sharing", F.lit(0)) > 1), "shared_host")
    return overlay.select("uid", F.when(reason.isNull(), root).alias("site"), reason.alias("reason"))


def best_candidate(candidates: DataFrame, key: str = "institution") -> DataFrame:
    """(key, url, probability): the likeliest candidate, ties to the earlier one; a null probability never wins."""
    best = candidates.where("probability IS NOT NULL").groupBy(key).agg(F.max(F.struct("probability", (-F.col("position")).alias("p_"), "url")).alias("best_"))
    return best.select(key, "best_.url", "best_.probability")


def linked_groups(rows: DataFrame, pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(scope, id, group): ids of one scope with the same name, or joined by pair answers of at least ``least``, name their group by its least id."""
    from .components import components

    node = lambda c: F.struct(F.col("scope"), F.col(c).alias("id"))
    first = rows.groupBy("scope", "name").agg(F.min("id").alias("first"))
    same = rows.join(first, ["scope", "name"]).select(node("id").alias("u"), node("first").alias("v"))
    said = pairs.where(F.col("probability") >= least).select(node("a").alias("u"), node("b").alias("v"))
    found = components(same.union(said))
    return rows.select("scope", "id").distinct().join(found.select(F.col("node.scope").alias("scope"), F.col("node.id").alias("id"), F.col("root.id").alias("group")), ["scope", "id"], "left").select("scope", "id", F.coalesce("group", "id").alias("group"))


def kept_artifacts(artifacts: DataFrame, kept: DataFrame) -> DataFrame:
    """Artifacts named by the md5 of a kept URL."""
    return artifacts.join(kept.select(F.md5("url").alias("stem")).distinct(), "stem", "left_semi")


def publishable(attributions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(uid, block, publishable): the block of (file, country, level), and whether it and the attribution both allow publication."""
    met = attributions.join(blocks, ["file", "country", "level"], "left")
    return met.select("uid", "block", (F.coalesce("allowed", F.lit(False)) & F.coalesce("attributed", F.lit(False))).alias("publishable"))


def length_shares(lengths: DataFrame, column: str, caps: tuple[int, ...]) -> DataFrame:
    """(cap, n_over, share_over): rows longer than each cap, in one pass."""
    counted = lengths.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(column) > c).alias(f"over_{c}") for c in caps])
    each = counted.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"over_{c}").alias("n_over")) for c in caps])).alias("one_"))
    return each.select("one_.cap", "one_.n_over", F.round(F.try_divide("one_.n_over", "n"), 4).alias("share_over"))


def cutoff_table(rows: DataFrame, score: str, label: str, cutoffs: tuple[float, ...]) -> DataFrame:
    """(cutoff, tp, fp, fn, tn, errors) at each cutoff (score >= cutoff is positive), in one pass."""
    hit, right = lambda c: F.col(score) >= c, F.col(label) == 1
    cells = {"tp": lambda c: hit(c) & right, "fp": lambda c: hit(c) & ~right, "fn": lambda c: ~hit(c) & right, "tn": lambda c: ~hit(c) & ~right}
    one = rows.agg(*[F.struct(F.lit(c).alias("cutoff"), *[F.count_if(test(c)).alias(n) for n, test in cells.items()]).alias(f"c{k}") for k, c in enumerate(cutoffs)])
    return one.select(F.explode(F.array(*[f"c{k}" for k in range(len(cutoffs))])).alias("one_")).select("one_.*", (F.col("one_.fp") + F.col("one_.fn")).alias("errors"))


def best_cutoff(table: DataFrame) -> DataFrame:
    """The row with the fewest errors, ties to the lower cutoff."""
    return table.agg(F.min(F.struct("errors", "cutoff", "tp", "fp", "fn", "tn")).alias("best_")).select("best_.*")


def preflight(sample: DataFrame, n: int, credit: float, usd: float) -> DataFrame:
    """(stage, credits, jobs, usd): what a run over n institutions will take, from a sample's per-institution means (institution, stage, credits, jobs, tokens)."""
    size = sample.select("institution").distinct().agg(F.count(F.lit(1)).alias("size"))
    sums = sample.groupBy("stage").agg(F.sum("credits").alias("credits"), F.sum("jobs").alias("jobs"), F.sum("tokens").alias("tokens")).join(F.broadcast(size))
    per = lambda c: F.col(c) * F.lit(n) / F.col("size")
    return sums.select("stage", F.round(per("credits"), 4).alias("credits"), F.ceil(per("jobs")).alias("jobs"), F.round(per("credits") * credit + per("tokens") * usd, 4).alias("usd"))


def seeded_totals(prior: DataFrame, calls: DataFrame, by: str = "api") -> DataFrame:
    """(by, units): running totals resumed from an earlier report."""
    return prior.select(by, "units").union(calls.select(by, "units")).groupBy(by).agg(F.round(F.sum("units"), 4).alias("units"))


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, allowed): of the rules (host, path, allow) of a URL's host the longest matching path decides, allowing on a tie; none allows."""
    met = urls.join(rules, "host", "left").where("path IS NULL OR startswith(url_path, path)")
    best = met.groupBy("id").agg(F.max(F.when(F.col("path").isNotNull(), F.struct(F.length("path").alias("n"), "allow"))).alias("best_"))
    return urls.select("id").join(best, "id", "left").select("id", F.coalesce("best_.allow", F.lit(True)).alias("allowed"))


def liveness(heartbeats: DataFrame, now: Column, timeout_s: float) -> DataFrame:
    """(run_id, live): whether a run's last heartbeat (seconds) is recent enough."""
    return heartbeats.groupBy("run_id").agg(F.max("at").alias("last")).select("run_id", ((now - F.col("last")) <= timeout_s).alias("live"))


def checked_code(presence: Column, entailed: Column, probability: Column, least: float = 0.5) -> Column:
    """struct(status, second): supported, or the first reason for which a code is downgraded, and the second one."""
    reasons = F.array_compact(F.array(F.when(~F.coalesce(presence, F.lit(False)), "downgraded_quote"), F.when(~F.coalesce(entailed, F.lit(False)), "downgraded_entailment"), F.when(~F.coalesce(probability >= least, F.lit(False)), "downgraded_probability")))
    return F.struct(F.coalesce(F.get(reasons, F.lit(0)), F.lit("supported")).alias("status"), F.get(reasons, F.lit(1)).alias("second"))


def extract_jobs(pages: DataFrame, batch: str, least: int, most: int) -> DataFrame:
    """(custom_id, institution, url, text): one job per page with enough text, its text capped; ids name the batch, institution and URL."""
    from ..functions.text import capped, strip

    kept = pages.where(F.length(strip(F.coalesce("text", F.lit("")))) >= least)
    return kept.select(F.concat_ws("::", F.lit(batch), F.col("institution").cast("string"), F.md5("url")).alias("custom_id"), "institution", "url", capped(F.col("text"), most, "head").alias("text"))


def page_artifact(parts: DataFrame, page: str = "page") -> DataFrame:
    """(page, text, segments): a page's parts joined in order, with where each lies; every part is added once to a running length."""
    rows = parts.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts_"))
    joined = F.array_join(F.transform("parts_", lambda p: p["text"]), "")
    lengths = F.concat_ws(",", F.transform("parts_", lambda p: F.concat_ws(":", p["part"].cast("string"), F.length(p["text"]).cast("string"))))
    return rows.select(page, joined.alias("text"), lengths.alias("segments"))


def preserved_identity(existing: DataFrame, fresh: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Fresh rows that keep the identity columns of the row they replace."""
    old = existing.select(key, *[F.col(c).alias(f"old_{c}") for c in identity])
    met = fresh.join(old, key, "left")
    return met.select(*[F.coalesce(f"old_{c}", c).alias(c) if c in identity else F.col(c) for c in fresh.columns])
