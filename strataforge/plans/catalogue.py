"""All queries of the core, over whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import extract, scoring
from strataforge.functions import text as T
from strataforge.operators import aggregates, dedup, drift, joins, timestamps, validate, windows
from strataforge.plans import records
from strataforge.plans.sql import SQL as _SQL
from strataforge.session import table

# ---- timestamps and drifting schemas


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.commit_instants(table(spark, d, "raw_commits"), table(spark, d, "repos"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.record_changes(table(spark, d, "context_records"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.enforce(table(spark, d, "context_records"), ["record_id", "stream_id", "file_seq", "record_no", "context_key"])


def p4_replayed(spark: SparkSession, d: str) -> DataFrame:
    """The table after two fields were approved that its schema didn't know."""
    return drift.replay(p4_table(spark, d), [("note", "summary.note", "string"), ("bypass_reasons", "summary.bypass_reason", "array<string>")])


# ---- joins


def _named_domains(spark: SparkSession, d: str) -> DataFrame:
    """One domain per repository and name, the first reported, without noise names."""
    rows = table(spark, d, "domains").filter(dedup.named(F.col("domain_name"))).withColumn("name", F.lower(F.trim("domain_name")))
    return rows.groupBy("repo_id", "name").agg(F.min_by(F.struct("domain_id", "paths", "keywords"), "domain_id").alias("w")).select("repo_id", "name", "w.*")


def classify_scored(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "change_units").select("unit_id", "repo_id", "theme", "summary", "section_name", "file_paths")
    return joins.scored_winner(units, _named_domains(spark, d), ["repo_id"], "unit_id", "name")


def prefix_assign(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "change_units").select("unit_id", "repo_id", "file_paths")
    return joins.prefix_winner(units, _named_domains(spark, d), ["repo_id"], "unit_id", "file_paths", "name", "paths", "domain_id")


def fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    return joins.fuzzy_pairs(table(spark, d, "domains"), ["repo_id"], "domain_id", "domain_name", "keywords", "paths")


def record_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every named domain, copies too, with its representative in ``fuzzy_pairs`` and its links."""
    return joins.record_classes(table(spark, d, "domains"), ["repo_id"], "domain_id", "domain_name", "keywords", "paths")


#: A catalogue of phrases and what else they are called.
PHRASES = [
    ("audit trail", ["log of the changes"]), ("court fee", []), ("grade book", ["exam sheet"]), ("gives_up", []), ("cold chain", ["truck fleet", "loading ramp"]),
    ("lab result", []), ("no behaviour changes", []), ("old demo", ["stays off"]),
]


def phrase_rank(spark: SparkSession, d: str) -> DataFrame:
    return joins.phrase_ranks(table(spark, d, "documents"), "doc_id", "text", PHRASES)


def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    return joins.unseen(table(spark, d, "raw_commits").select("raw_id", "commit_id"), table(spark, d, "change_units").select("commit_id"), ["commit_id"])


def _content(commits: DataFrame) -> DataFrame:
    body = F.concat_ws("\n", F.array_join("files", "\n"), F.array_join("diff_chunks", "\n"), F.coalesce("author", F.lit("")))
    return commits.select("commit_id", "raw_id", "ingested_at", F.sha2(body, 256).alias("digest"))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Commits as first delivered against as last delivered; those of units alone are added, those without units removed."""
    rows = _content(table(spark, d, "raw_commits")).filter(F.col("commit_id").isNotNull())
    old = rows.groupBy("commit_id").agg(F.min_by("digest", F.struct("ingested_at", "raw_id")).alias("digest"))
    now = rows.groupBy("commit_id").agg(F.max_by("digest", F.struct("ingested_at", "raw_id")).alias("digest"))
    units = table(spark, d, "change_units").filter(F.col("commit_id").isNotNull()).select("commit_id").distinct()
    new = units.join(now, "commit_id", "left")
    return joins.snapshot_diff(old, new, "commit_id", "digest")


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Current text digests of documents against a cache of those written before 2023, with a year to live."""
    docs = table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("digest"), "written_at")
    cache = docs.filter(F.col("written_at") < F.lit("2023-01-01").cast("timestamp"))
    return joins.cache_lookup(docs.select("doc_id", "digest"), cache, "doc_id", "digest", "written_at", F.lit("2023-01-01").cast("timestamp"), 24.0 * 365)


def index_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Commits listed by units against commits collected."""
    listed = table(spark, d, "change_units").filter(F.col("commit_id").isNotNull())
    held = table(spark, d, "raw_commits").groupBy("commit_id").agg(F.bool_or(F.coalesce(F.size("diff_chunks"), F.lit(0)) > 0).alias("ok")).filter(F.col("commit_id").isNotNull())
    return joins.consistency(listed, held, "commit_id", "ok")


def context_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Per repository the newest usable context record, full ones before others."""
    rows = table(spark, d, "context_records").select("repo_id", "record_id", F.get_json_object("payload", "$.summary.bootstrap_status").alias("status")).filter("status is not null and repo_id is not null")
    return joins.first_by_priority(rows, ["repo_id"], F.struct((F.col("status") != "full").alias("a"), (-F.col("record_id")).alias("b")))


#: Models with the wording that refers to them and the type they stand for.
MODELS = [
    {"name": "gives up", "development_type": "bugfix"}, {"name": "no longer imports", "development_types": ["unknown", "refactor"]},
    {"id": "after the", "summary": "was cached", "hints": ["optimize"]}, {"name": "users asked", "development_type": "feature"},
]


def model_hints(spark: SparkSession, d: str) -> DataFrame:
    return joins.model_hint(table(spark, d, "documents").filter(F.col("text").isNotNull()), "doc_id", "text", MODELS, list(validate.DEVELOPMENT))


def term_lines(spark: SparkSession, d: str) -> DataFrame:
    """Up to three lines of the documents for each name of a repository's parts."""
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    lines = docs.select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    symbols = table(spark, d, "repos").select(F.substring_index("repo_name", "-", 1).alias("symbol"))
    return joins.symbol_matches(lines, symbols).select("symbol", F.col("path").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"))


# ---- distinct and merged records


def _phrased(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "lang", "text", T.phrase(F.col("text")).alias("key")).filter("key <> ''")


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_wins(_phrased(spark, d).select("doc_id", F.md5("key").alias("key")), ["key"], "doc_id").select("doc_id", "kept")


def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_commits").select("commit_id", "raw_id", "author", "ingested_at")
    return dedup.last_wins(rows, ["commit_id"], ["ingested_at", "raw_id"]).select("commit_id", "raw_id", "author")


def merged_domains(spark: SparkSession, d: str) -> DataFrame:
    return dedup.merge_records(table(spark, d, "domains"), "repo_id", "domain_id", "domain_name")


def distinct_files(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "raw_commits")
    required = ["README.md", "pkg", "src"]
    return c.select(
        "raw_id", dedup.sorted_distinct(F.col("files")).alias("sorted_files"), dedup.ordered_distinct(F.col("files")).alias("ordered_files"),
        F.array_except(F.lit(required), F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda f: F.substring_index(f, "/", 1))).alias("missing"),
    )


def aliases_ci(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keywords of each domain without case, first spelling kept."""
    return table(spark, d, "domains").filter(F.col("keywords").isNotNull()).select("domain_id", dedup.ordered_distinct_ci(F.col("keywords")).alias("keywords"))


def canonical_cases(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "change_units").filter(F.col("summary").isNotNull()).select(
        "unit_id", F.explode(F.array_distinct(F.transform(dedup.filled_or(F.col("file_paths"), ""), scoring.module_of))).alias("module"), F.lower(F.trim("op")).alias("op"),
        T.phrase(F.regexp_replace("summary", r"\d+", "0")).alias("issue"), F.when(F.lower(F.trim("importance")) == "primary", "high").otherwise("low").alias("value"), "summary",
    )
    return dedup.canonical_case(u.filter("op is not null"), ["module", "op", "issue"], "value", "summary", "unit_id").select("module", "op", "issue", "unit_id", "cases")


# ---- aggregations


def hotspot_topk(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.top_modules(table(spark, d, "raw_commits"), "raw_id", "files")


def _units(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "change_units")
    low = lambda c, other: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit(other))
    return u.select("unit_id", "commit_id", "repo_id", "file_paths", F.trim("summary").alias("summary"), low("theme", "unknown").alias("theme"), low("op", "other").alias("op"), low("importance", "secondary").alias("importance"))


def distribution(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.distribution(_units(spark, d), F.col("op"), "unit_id")


def theme_distribution(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.distribution(_units(spark, d), F.col("theme"), "unit_id")


def representatives(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.representatives(_units(spark, d), F.col("theme"), "summary", "unit_id")


def health_metrics(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size("file_paths"), F.lit(0))
    u = _units(spark, d)
    return aggregates.health(u, n >= 3, F.length("summary") < 60, (n >= 2) & F.col("commit_id").isNotNull(), F.col("theme") != "unknown", ~F.contains(F.lower("summary"), F.substring_index("theme", " ", -1)))


def feedback_pivot(spark: SparkSession, d: str) -> DataFrame:
    u = _units(spark, d)
    return aggregates.feedback(u.withColumn("outcome", F.when(F.col("op").isin("feat", "bugfix"), "accepted").when(F.col("op").isin("cleanup", "docs"), "rejected").otherwise("other")), "importance", "outcome")


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.conflicts(_phrased(spark, d).select("doc_id", "source", F.md5("key").alias("key")), ["key"], "source", "doc_id").select("first_id", "n_rows", "n_sources")


def adjudicated(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size("file_paths"), F.lit(0)) - 1
    return _units(spark, d).select(aggregates.adjudicated(n, F.col("summary")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def signals(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.signals(table(spark, d, "documents"), "doc_kind")


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"), F.col("written_at").isNotNull().alias("hit"))
    return aggregates.size_summary(docs, "size", "hit")


def theme_patterns(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.theme_patterns(_units(spark, d), F.col("theme"), "commit_id", F.col("op"), F.col("importance"))


def op_distribution(spark: SparkSession, d: str) -> DataFrame:
    g = aggregates.op_distribution(_units(spark, d), F.col("theme"), F.col("op"))
    return g.select("theme", F.explode("ops").alias("op", "n"))


def demand_score(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.demand_scores(_units(spark, d), F.col("theme"), "commit_id", F.col("importance"))


def unit_summary(spark: SparkSession, d: str) -> DataFrame:
    at = table(spark, d, "raw_commits").filter(F.col("commit_id").isNotNull()).groupBy("commit_id").agg(F.min("ingested_at").alias("at"))
    s = aggregates.unit_summary(_units(spark, d).join(at, "commit_id", "left"), F.col("theme"), F.col("op"), F.col("at"), validate.OPS)
    return s.select("total_units", "total_patterns", "bugfix_ratio", F.transform("ops", lambda o: F.format_string("%s=%d", o["op"], o["n"])).alias("ops"), F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


def repo_bands(spark: SparkSession, d: str) -> DataFrame:
    g = _units(spark, d).groupBy("repo_id").agg(F.count_distinct("theme").alias("themes"))
    return g.select("repo_id", "themes", aggregates.banded(F.col("themes")).alias("band"))


def change_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Order states as decisions, decisions as outcomes."""
    action = F.when(F.col("o_orderstatus") == "F", "keep").when(F.col("o_orderstatus") == "O", "backlog").when(F.col("o_orderstatus") == "P", "verify_first").otherwise("drop")
    o = table(spark, d, "orders").select(scoring.outcome(action).alias("outcome"), "o_totalprice")
    return o.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("largest"))


# ---- order within keys


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Commits in batches for processing: a run is what a repository delivered on one day, weight its changed lines."""
    c = table(spark, d, "raw_commits")
    chunks = F.coalesce("diff_chunks", F.array().cast("array<string>"))
    weight = F.coalesce(F.aggregate(chunks, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.length(x), F.lit(0))), F.lit(0))
    runs = c.select("repo_id", F.to_date("ingested_at").alias("day"), "raw_id", weight.alias("w"))
    return windows.batches(runs, ["repo_id", "day"], "raw_id", "w").select("repo_id", "day", "raw_id", "batch")


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "context_records").select("stream_id", "context_key", "file_seq", "record_id", F.coalesce(F.length("payload"), F.lit(0)).alias("bytes"))
    f = f.groupBy("stream_id", "context_key", "file_seq").agg(F.min("record_id").alias("record_id"), F.max("bytes").alias("bytes"))
    return windows.latest_version(f, ["stream_id", "context_key"], "file_seq", "bytes").select("stream_id", "context_key", "file_seq", "record_id")


def latest_valid_version(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "context_records").select("stream_id", "context_key", "file_seq", F.coalesce(F.length("payload"), F.lit(0)).alias("bytes"), F.get_json_object("payload", "$.summary.fingerprint").alias("fp"))
    f = f.groupBy("stream_id", "context_key", "file_seq").agg(F.max("bytes").alias("bytes"), F.max("fp").alias("fp"))
    return windows.latest_version(f, ["stream_id", "context_key"], "file_seq", "bytes", F.col("fp").isNotNull()).select("stream_id", "context_key", "file_seq")


def retention(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "context_records").filter(F.col("stream_id").isNotNull()).groupBy("stream_id", "file_seq").agg(F.count("*").alias("n"))
    return windows.retained(f, ["stream_id"], "file_seq", F.col("n") >= 12).select("stream_id", "file_seq", "keep")


def ttl_live(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts")
    return e.filter(joins.live(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 72.5)).select("event_id")


def lru_evict(spark: SparkSession, d: str) -> DataFrame:
    return windows.evicted(table(spark, d, "domains").select("domain_id", "seen_at"), "domain_id", "seen_at", 500)


def arbitrate(spark: SparkSession, d: str) -> DataFrame:
    """Domain descriptions claimed by several sources: one wins per repository and beginning."""
    rows = table(spark, d, "domains").filter(T.nonblank(F.col("description")) & F.col("repo_id").isNotNull()).withColumn("head", F.substring("description", 1, 80))
    rank = F.when(F.col("source") == "architect", 0).when(F.col("source") == "hotspot", 1).when(F.col("source") == "codebase", 2).otherwise(99)
    return windows.arbitrated(rows, ["repo_id", "head"], "domain_id", "description", [rank, F.col("seen_at").isNull().cast("int")])


def sections(spark: SparkSession, d: str) -> DataFrame:
    return windows.sections(table(spark, d, "documents"), "doc_id", "text")


def section_bodies(spark: SparkSession, d: str) -> DataFrame:
    b = windows.section_bodies(table(spark, d, "documents"), "doc_id", "text")
    return b.filter(F.length("content") >= 20).select("doc_id", "section_no", "title", F.length("content").cast("bigint").alias("chars"))


def repeated_sections(spark: SparkSession, d: str) -> DataFrame:
    s = windows.sections(table(spark, d, "documents"), "doc_id", "text").filter("title <> ''")
    return dedup.unique_sections(s, "doc_id", "title").groupBy("doc_id").agg(F.count("*").alias("n"))


def card_concepts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("doc_kind = 'demand_card'")
    return t.select("doc_id", windows.bullets_after(F.col("text"), "concepts").alias("concepts")).filter(F.size("concepts") > 0)


def low_confidence(spark: SparkSession, d: str) -> DataFrame:
    return windows.low_confidence(table(spark, d, "documents"), "doc_id", "text", ("confidence", "low"))


# ---- checks


def errors_array(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "change_units").select("unit_id", validate.unit_errors().alias("errors"))
    return e.filter(F.size("errors") > 0)


def fact_errors(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "change_units")
    fact = u.select(
        F.col("unit_id").alias("fact_id"), F.when(F.lower("op").isin("config", "compat"), "dependency_rule").when(F.lower("op") == "test", "invariant").otherwise(F.col("op")).alias("fact_type"),
        F.col("summary").alias("statement"), F.col("importance").alias("source"),
        F.transform("file_paths", lambda p: F.struct(F.when(F.contains(p, F.lit("test")), "test_case").otherwise("file_path").alias("locator_type"), F.nullif(p, F.lit("")).alias("locator"))).alias("evidence"),
    )
    return fact.select("fact_id", validate.fact_error().alias("error")).filter("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def card_errors(spark: SparkSession, d: str) -> DataFrame:
    """Domains written as demand cards: the source is the development type, a missing text or list stays out of the card."""
    m = table(spark, d, "domains")
    card = F.struct(
        F.struct(F.col("domain_name").alias("issue_id"), F.col("description").alias("issue_text")).alias("request_source"),
        F.struct(F.col("keywords").alias("domains"), F.col("paths").alias("concepts"), F.array().cast("array<string>").alias("rules"), F.when(F.col("repo_id") > 20, F.array().cast("array<string>")).alias("invariants"), F.when(F.col("repo_id") < 5, F.lit(1)).alias("owner")).alias("mapping"),
        F.when(F.col("source") == "hotspot", "bugfix").otherwise(F.col("source")).alias("development_type"), F.when(F.col("repo_id") != 7, F.struct(F.array(F.lit("why")).alias("open_questions"))).alias("uncertainties"),
    )
    return validate.with_json(m, F.to_json(F.struct(card.alias("demand_card")))).select("domain_id", validate.card_errors(F.col("json")).alias("errors"))


def missing_headings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("doc_kind in ('change_analysis', 'design_note', 'dossier_section')")
    return t.select("doc_id", validate.missing_headings(F.col("text"), ("Risk of", "Change", "Missing")).alias("missing"), validate.any_heading(F.col("text"), ("Risk", "Change")).alias("any"))


def stable_rule(spark: SparkSession, d: str) -> DataFrame:
    """Orders as capabilities: lines are the evidence, priority the confidence."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    conf = F.when(F.startswith("o_orderpriority", F.lit("1")), "high").when(F.startswith("o_orderpriority", F.lit("3")), "medium").otherwise("low")
    n = F.coalesce("n", F.lit(0))
    keep = validate.stable(F.col("o_orderkey").cast("string"), F.array_repeat(F.lit("line"), n.cast("int")), conf)
    return o.filter(keep).groupBy(conf.alias("confidence")).agg(F.count("*").alias("n"), F.sum(n).alias("evidence"))


# ---- scalars and extraction


def recommend(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("s"))
    c = table(spark, d, "customer").join(orders, "c_custkey", "left").withColumn("conf", F.when(F.col("c_acctbal") > 6000, "high").when(F.col("c_acctbal") > 0, "medium").otherwise("low"))
    n, s = F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0))
    b, v = scoring.scores(F.col("conf"), n, s)
    out = c.select("c_custkey", scoring.stable_id("customer", F.col("c_name"), "rec_").alias("rec_id"), b.alias("business"), v.alias("value"), scoring.valid(F.col("conf"), n, F.col("c_name")).alias("validity"))
    return out.withColumn("action", scoring.recommended(F.col("validity"), F.greatest("business", "value")))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scoring.stable_id("part", F.col("p_name")).alias("id"), F.substring(F.sha2(F.coalesce("p_name", F.lit("")), 256), 1, 16).alias("digest"))


def development_types(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter(F.col("text").isNotNull())
    k = t.select("doc_id", F.inline(F.array(F.struct(scoring.kinds_of(F.col("text")).alias("k")))))  # the words are looked for once
    return k.select("doc_id", F.coalesce(F.get("k", F.lit(0)), F.lit("feature")).alias("development_type"), F.array_sort("k").alias("kinds"), scoring.open_question(F.lit(""), F.col("k")).alias("question"))


def intents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scoring.intent(F.col("text")).alias("intent")).groupBy("intent").agg(F.count("*").alias("n"))


def normalised_texts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", F.md5(T.normalise_text(F.col("text"), numbers=True)).alias("digest"), F.length(T.normalise_text(F.col("text"), numbers=True)).cast("bigint").alias("chars"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return t.select("doc_id", F.size(T.tokens(F.col("text"))).cast("bigint").alias("n_tokens"), F.size(T.signal_tokens(F.col("text"))).cast("bigint").alias("n_signal"), F.length(T.phrase(F.col("text"))).cast("bigint").alias("phrase_chars"))


def diff_stats(spark: SparkSession, d: str) -> DataFrame:
    """Path, added and removed lines of every diff chunk, summed by path."""
    c = table(spark, d, "raw_commits").select(F.explode("diff_chunks").alias("c")).filter(F.col("c").isNotNull())
    s = c.select(extract.chunk_path(F.col("c")).alias("path"), extract.added_lines(F.col("c")).alias("a"), extract.removed_lines(F.col("c")).alias("r"))
    return s.groupBy("path").agg(F.count("*").alias("chunks"), F.sum("a").alias("added"), F.sum("r").alias("removed"))


def file_filters(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "raw_commits").filter(F.col("files").isNotNull())
    return c.select("raw_id", F.size(extract.kept_files(F.col("files"), ["docs/", "build/"])).cast("bigint").alias("kept"), F.size(extract.test_files(F.col("files"))).cast("bigint").alias("tests"))


def doc_facts(spark: SparkSession, d: str) -> DataFrame:
    return extract.facts(table(spark, d, "documents"), "doc_id", "text")


def context_aliases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "context_records").select("record_id", F.inline(extract.aliases(F.col("payload"))))


def context_modes(spark: SparkSession, d: str) -> DataFrame:
    j = lambda p: F.get_json_object("payload", p)
    r = table(spark, d, "context_records").select(
        j("$.summary.bootstrap_status").alias("status"), j("$.summary.fingerprint").alias("fp"), j("$.summary").alias("s"),
        (F.coalesce(F.json_array_length(j("$.shared_hints.local_capabilities")), F.lit(0)) + F.coalesce(F.json_array_length(j("$.shared_hints.aliases")), F.lit(0))).alias("hints"),
    )
    mode = scoring.context_mode(F.col("s").isNotNull(), F.col("status"), F.coalesce(F.substring("fp", 1, 1) < "c", F.lit(False)), F.col("hints"))
    return r.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


def month_partition(spark: SparkSession, d: str) -> DataFrame:
    month = scoring.month_of(F.date_format("ingested_at", "yyyy-MM-dd"))
    return table(spark, d, "raw_commits").groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.count_distinct("commit_id").alias("commits"))


def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of the Python blocks in documents."""
    block = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)```py\n(.*?)```"), 1))
    code = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", block.alias("code"))
    return extract.symbol_table(code, "doc_id", "code").unionByName(code.select("doc_id", F.lit("block").alias("kind"), F.substring_index("code", "(", 1).alias("name"), F.lit(1).alias("line")))


_ALL = (
    p2_found, p4_found, p4_table, p4_replayed, classify_scored, prefix_assign, fuzzy_pairs, record_classes, phrase_rank, resume_anti, snapshot_diff, cache_hits, index_consistency,
    context_precedence, model_hints, term_lines, dedup_first, dedup_last, merged_domains, distinct_files, aliases_ci, canonical_cases, hotspot_topk, distribution,
    theme_distribution, representatives, health_metrics, feedback_pivot, conflicts, adjudicated, signals, cache_stats, theme_patterns, op_distribution, demand_score,
    unit_summary, repo_bands, change_buckets, batches, latest_version, latest_valid_version, retention, ttl_live, lru_evict, arbitrate, sections, section_bodies,
    repeated_sections, card_concepts, low_confidence, errors_array, fact_errors, card_errors, missing_headings, stable_rule, recommend, stable_ids, development_types,
    intents, normalised_texts, token_counts, diff_stats, file_filters, doc_facts, context_aliases, context_modes, month_partition, code_symbols,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL} | records.QUERIES
SQL: dict[str, str] = _SQL | records.SQL
