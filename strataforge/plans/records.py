"""Further queries of the core, operator by operator, each beside its SQL for DuckDB; over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import extract, scoring
from strataforge.functions import text as T
from strataforge.operators import aggregates, dedup, joins, validate, windows
from strataforge.session import table
from strataforge.sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_COMMITTED = "coalesce(ingested_at, TIMESTAMP '1970-01-01')"


# ---- joins


@_query("""WITH m AS (SELECT domain_id, coalesce(len(list_filter(keywords, lambda k: contains(lower(k), 'core'))), 0) AS hits, coalesce(len(paths), 0) > 0 AS o, keywords AS k FROM domains)
 SELECT domain_id, CASE WHEN hits > 0 THEN list_filter(k, lambda x: contains(lower(x), 'core')) WHEN o THEN coalesce(k, []) ELSE [] END AS kept FROM m""")
def fallback_matches(spark: SparkSession, d: str) -> DataFrame:
    """Keywords with a given part; all of them where none has it but the domain has paths."""
    none = F.array().cast("array<string>")
    k = F.coalesce("keywords", none)
    hits = F.filter(k, lambda x: F.contains(F.lower(x), F.lit("core")))
    return table(spark, d, "domains").select("domain_id", joins.with_fallback(hits, F.coalesce(F.size("paths"), F.lit(0)) > 0, k).alias("kept"))


@_query("""WITH r AS (SELECT commit_id, coalesce(strftime(ingested_at, '%Y-%m'), 'unknown') AS month, author, raw_id, ingested_at FROM raw_commits WHERE commit_id IS NOT NULL),
 l AS (SELECT commit_id, month, raw_id FROM r WHERE trim(coalesce(author, '')) <> '' QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY ingested_at DESC NULLS LAST, raw_id DESC) = 1)
 SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.commit_id = l.commit_id AND o.month = l.month AND trim(coalesce(o.author, '')) = '')""")
def unseen_in_month(spark: SparkSession, d: str) -> DataFrame:
    """The last signed delivery of each commit, unless an unsigned one fell in the same month."""
    r = table(spark, d, "raw_commits").select("commit_id", scoring.month_of(F.date_format("ingested_at", "yyyy-MM-dd")).alias("month"), "author", "raw_id", "ingested_at")
    signed = F.trim(F.coalesce("author", F.lit(""))) != ""
    new = dedup.last_wins(r.filter(signed), ["commit_id"], ["ingested_at", "raw_id"])
    return joins.unseen(new, r.filter(~signed), ["commit_id", "month"]).select("commit_id", "month", "raw_id")


@_query("""WITH f AS (SELECT stream_id || ':' || coalesce(context_key, '') AS name, file_seq, written_at FROM context_records WHERE stream_id IS NOT NULL),
 c AS (SELECT name, max(file_seq) AS now FROM f GROUP BY name), s AS (SELECT name, max(file_seq) AS saved FROM f WHERE written_at < TIMESTAMP '2023-01-01' GROUP BY name)
 SELECT coalesce(c.name, s.name) AS name, CASE WHEN saved IS NULL THEN 'not in snapshot' WHEN now IS NULL THEN 'missing now' ELSE 'snapshot has v' || saved || ', current is v' || now END AS warning
 FROM c FULL JOIN s ON c.name = s.name WHERE saved IS NULL OR now IS NULL OR saved <> now""")
def version_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Contexts whose newest file isn't the one that a snapshot of 2023 has."""
    f = table(spark, d, "context_records").filter("stream_id is not null").select(F.concat(F.col("stream_id").cast("string"), F.lit(":"), F.coalesce("context_key", F.lit(""))).alias("name"), "file_seq", "written_at")
    newest = lambda rows: rows.groupBy("name").agg(F.max("file_seq").alias("version"))
    return joins.version_skew(newest(f), newest(f.filter(F.col("written_at") < F.lit("2023-01-01").cast("timestamp"))), "name", "version")


@_query(f"""WITH r AS (SELECT commit_id, author, array_to_string(files, chr(10)) AS fs, row_number() OVER (PARTITION BY commit_id ORDER BY {_COMMITTED}, raw_id) AS a, row_number() OVER (PARTITION BY commit_id ORDER BY {_COMMITTED} DESC, raw_id DESC) AS z
   FROM raw_commits WHERE commit_id IS NOT NULL)
 SELECT x.commit_id, x.author IS NOT DISTINCT FROM y.author AND x.fs IS NOT DISTINCT FROM y.fs AS same FROM r x JOIN r y ON x.commit_id = y.commit_id AND x.a = 1 AND y.z = 1""")
def same_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first and the last delivery of a commit agree, nulls included."""
    at = F.struct(F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp")), "raw_id")
    what = F.struct("author", F.sha2(F.array_join("files", "\n"), 256).alias("files"))
    g = table(spark, d, "raw_commits").filter("commit_id is not null").groupBy("commit_id").agg(F.min_by(what, at).alias("a"), F.max_by(what, at).alias("z"))
    return g.select("commit_id", joins.same_fingerprint([F.col("a.author"), F.col("a.files")], [F.col("z.author"), F.col("z.files")]).alias("same"))


@_query("""SELECT (SELECT bool_or(o_orderstatus = 'P') FROM orders) AND ((SELECT count(*) FROM lineitem) = 0 OR (SELECT bool_or(l_linestatus = 'O') FROM lineitem)) AS blocked""")
def finalize_blocked(spark: SparkSession, d: str) -> DataFrame:
    """Orders to be verified against lines that are still open."""
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "verify_first").otherwise("keep").alias("action"))
    li = table(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "O", "pending").otherwise("done").alias("status"))
    return joins.blocked(o, li, "action", "status")


# ---- distinct values and unions


@_query("""SELECT origin, count(*) AS n, count(name) AS names, count(importance) AS levels FROM (
   SELECT 'domain' AS origin, domain_name AS name, NULL AS importance FROM domains UNION ALL SELECT 'unit', NULL, importance FROM change_units UNION ALL SELECT 'term', canonical, NULL FROM canonical_terms) GROUP BY origin""")
def united_sources(spark: SparkSession, d: str) -> DataFrame:
    """Three tables with different columns as one, counted by origin."""
    u = dedup.union_sources(
        table(spark, d, "domains").select(F.lit("domain").alias("origin"), F.col("domain_name").alias("name")), table(spark, d, "change_units").select(F.lit("unit").alias("origin"), "importance"),
        table(spark, d, "canonical_terms").select(F.lit("term").alias("origin"), F.col("canonical").alias("name")),
    )
    return u.groupBy("origin").agg(F.count("*").alias("n"), F.count("name").alias("names"), F.count("importance").alias("levels"))


_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]+'))"


@_query(f"""WITH t AS (SELECT unit_id, {_TOKENS.format(c="theme")} AS a, {_TOKENS.format(c="summary")} AS b FROM change_units)
 SELECT unit_id, len(list_intersect(a, b)) AS shared, coalesce(round(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 6), 0) AS smaller, coalesce(round(len(list_intersect(a, b)) / nullif(greatest(len(a), len(b)), 0), 6), 0) AS larger FROM t""")
def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """How far the words of a unit's theme are those of its summary."""
    t = table(spark, d, "change_units").select("unit_id", T.tokens(F.coalesce("theme", F.lit(""))).alias("a"), T.tokens(F.coalesce("summary", F.lit(""))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return t.select("unit_id", F.size(dedup.intersection(a, b)).cast("bigint").alias("shared"), F.round(dedup.overlap_smaller(a, b), 6).alias("smaller"), F.round(dedup.overlap_larger(a, b), 6).alias("larger"))


# ---- aggregations


@_query("""WITH s AS (SELECT coalesce(theme, '') AS path, CASE op WHEN 'feat' THEN 'class' WHEN 'bugfix' THEN 'function' ELSE 'method' END AS kind, section_name, unit_id FROM change_units)
 SELECT path, count_if(kind = 'class') AS classes, coalesce(list_slice(list(section_name ORDER BY unit_id) FILTER (kind = 'class'), 1, 5), []) AS first_classes, count_if(kind = 'function') AS functions FROM s GROUP BY path""")
def symbols_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Units as symbols: themes are the files, features the classes, fixes the functions."""
    kind = F.when(F.col("op") == "feat", "class").when(F.col("op") == "bugfix", "function").otherwise("method")
    s = table(spark, d, "change_units").select(F.coalesce("theme", F.lit("")).alias("path"), kind.alias("kind"), F.col("section_name").alias("name"), F.col("unit_id").alias("line"))
    return extract.symbol_summary(s, "path")


@_query(r"""WITH f AS (SELECT DISTINCT context_key AS artifact, file_seq AS v FROM context_records WHERE context_key IS NOT NULL AND file_seq >= 0)
 SELECT artifact, list(v ORDER BY v) AS versions FROM f GROUP BY artifact""")
def artifact_versions(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "context_records").select(F.concat("context_key", F.lit(".v"), F.col("file_seq").cast("string"), F.lit(".json")).alias("name")).filter("name is not null")
    return aggregates.versions(f, "name")


@_query("SELECT doc_kind, written_at IS NOT NULL AS dated, row_number() OVER (PARTITION BY doc_kind ORDER BY repo_id NULLS FIRST, doc_id) AS place, doc_id FROM documents")
def merged_signals(spark: SparkSession, d: str) -> DataFrame:
    """Documents as signals, by kind in the order of repository and id; the place shows the order."""
    docs = table(spark, d, "documents").select("doc_kind", "repo_id", "doc_id", F.col("written_at").isNotNull().alias("dated"))
    m = aggregates.merged_signals(docs, "repo_id", "doc_id", "doc_kind", "dated")
    from pyspark.sql import Window as W

    return m.select("doc_kind", "dated", F.row_number().over(W.partitionBy("doc_kind").orderBy("repo_id", "doc_id")).cast("bigint").alias("place"), "doc_id")


@_query("""WITH j AS (SELECT CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM context_records),
 v AS (SELECT coalesce(json_array_length(p, '$.shared_hints.local_capabilities'), 0) AS c, coalesce(json_array_length(p, '$.shared_hints.aliases'), 0) AS a FROM j)
 SELECT c + a AS hints, c AS capabilities, a AS aliases, count(*) AS n FROM v GROUP BY ALL""")
def hint_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many contexts hold how many hints."""
    arr = lambda p: F.from_json(F.get_json_object("payload", p), "array<variant>")
    r = table(spark, d, "context_records").select(arr("$.shared_hints.local_capabilities").alias("c"), arr("$.shared_hints.aliases").alias("a"))
    total, by = aggregates.hint_counts({"c": F.col("c"), "a": F.col("a")}, {"capabilities": F.col("c"), "aliases": F.col("a")})
    return r.select(total.alias("hints"), by.alias("by")).groupBy("hints", F.col("by.capabilities").alias("capabilities"), F.col("by.aliases").alias("aliases")).agg(F.count("*").alias("n"))


@_query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'added' WHEN 'O' THEN 'deferred' ELSE 'merged' END AS bucket, 'order ' || o_orderkey AS name, o_orderpriority AS kind, o_orderstatus AS reason, CASE WHEN o_orderstatus = 'P' THEN 'customer ' || o_custkey END AS target
 FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')""")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """Orders as decisions of a change log."""
    action = F.when(F.col("o_orderstatus") == "F", "keep").when(F.col("o_orderstatus") == "O", "backlog").when(F.col("o_orderstatus") == "P", "merge")
    o = table(spark, d, "orders").select(action.alias("a"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("n"), "o_orderpriority", "o_orderstatus", F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("t"))
    return aggregates.change_log(o, "a", "n", "o_orderpriority", "o_orderstatus", "t")


@_query("""SELECT count(*) AS cases, round(count_if(importance = 'primary') / count(*), 4) AS pass_rate, round(count_if(op = 'bugfix') / count(*), 4) AS bugfix_ratio, round(count_if(len(file_paths) >= 3) / count(*), 4) AS split_ratio FROM change_units""")
def export_statistics(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.export_statistics(table(spark, d, "change_units"), F.col("importance") == "primary", F.col("op") == "bugfix", F.size("file_paths") >= 3)


@_query("""WITH c AS (SELECT unit_id AS fact_id, summary AS statement, CASE WHEN len(file_paths) > 2 THEN 'evidence_backed' WHEN len(file_paths) = 2 THEN 'weakly_backed' ELSE 'gap' END AS status, NULL AS source FROM change_units)
 SELECT fact_id, statement, status, source FROM c WHERE status <> 'gap' UNION ALL SELECT domain_id, description, NULL, source FROM domains""")
def adjudicated_facts(spark: SparkSession, d: str) -> DataFrame:
    """Domain descriptions as facts, with the units that were found in enough files."""
    status = aggregates.adjudicated(F.coalesce(F.size("file_paths"), F.lit(0)) - 1, F.lit(""))
    claims = table(spark, d, "change_units").select(F.col("unit_id").alias("fact_id"), F.col("summary").alias("statement"), status.alias("status"))
    facts = table(spark, d, "domains").select(F.col("domain_id").alias("fact_id"), F.col("description").alias("statement"), "source")
    return aggregates.adjudicated_facts(claims, facts, "status").select("fact_id", "statement", "status", "source")


@_query("SELECT unit_id, commit_id, section_name, theme, importance, op, summary FROM change_units WHERE commit_id IS NOT NULL")
def nested_units(spark: SparkSession, d: str) -> DataFrame:
    """Units nested by commit as sections with items, and taken apart again."""
    u = table(spark, d, "change_units").filter("commit_id is not null")
    item = F.struct("op", "summary")
    section = F.struct(F.col("section_name").alias("name"), "theme", "importance", "summary", F.array(item).alias("items"))
    return aggregates.nested_units(u.select("unit_id", "commit_id", F.array(section).alias("sections")), "sections", ["unit_id", "commit_id"])


# ---- order within keys


_STAGES = ["feat", "bugfix", "refactor", "docs", "test"]


@_query(f"""WITH o AS (SELECT commit_id, list(DISTINCT op) FILTER (op IS NOT NULL) AS done FROM change_units WHERE commit_id IS NOT NULL GROUP BY commit_id)
 SELECT commit_id, list_filter({_STAGES}, lambda s: NOT list_contains(coalesce(done, []), s))[1] AS next FROM o""")
def next_stages(spark: SparkSession, d: str) -> DataFrame:
    """The first kind of change that a commit has no unit of."""
    o = table(spark, d, "change_units").filter("commit_id is not null").groupBy("commit_id").agg(F.collect_set("op").alias("done"))
    return o.select("commit_id", windows.next_stage(_STAGES, F.col("done")).alias("next"))


# ---- checks


@_query(r"""WITH t AS (SELECT doc_id, text, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents WHERE doc_kind = 'change_analysis'),
 h AS (SELECT doc_id, text, ls, list_transform(ls, lambda x: regexp_extract(trim(x), '^##\s+(.+?)\s*$', 1)) AS ts FROM t),
 n AS (SELECT h.doc_id, text, ls, ts, name, i AS k, list_max(list_filter(range(1, len(ts) + 1), lambda j: ts[j] = name)) AS pos FROM h CROSS JOIN (VALUES (1, 'Risk of'), (2, 'Change')) v(i, name)),
 b AS (SELECT doc_id, text, name, k, pos, list_slice(ls, pos + 1, coalesce(list_min(list_filter(range(1, len(ts) + 1), lambda j: j > pos AND ts[j] <> '')), len(ls) + 1) - 1) AS body FROM n),
 e AS (SELECT doc_id, text, k, CASE WHEN pos IS NULL THEN name || ': missing' WHEN len(list_filter(body, lambda x: trim(x) <> '')) = 0 THEN name || ': empty'
   WHEN len(list_filter(body, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) = 0 THEN name || ': nothing but headings' END AS e1,
   CASE WHEN name = 'Change' AND pos IS NOT NULL AND NOT contains(lower(array_to_string(body, chr(10))), 'pipeline:') THEN name || ': no pipeline:' END AS e2 FROM b)
 SELECT doc_id, CASE WHEN any_value(text) IS NULL OR any_value(trim(text, E' \t\r\n')) = '' THEN ['empty text'] ELSE list_filter(flatten(list([e1, e2] ORDER BY k)), lambda x: x IS NOT NULL) END AS errors FROM e GROUP BY doc_id
 UNION ALL SELECT doc_id, ['empty text'] FROM documents WHERE doc_kind = 'change_analysis' AND text IS NULL AND doc_id NOT IN (SELECT doc_id FROM e)""")
def analysis_errors(spark: SparkSession, d: str) -> DataFrame:
    """Change analyses without certain sections, or with empty ones."""
    t = table(spark, d, "documents").filter("doc_kind = 'change_analysis'")
    return t.select("doc_id", validate.section_errors(F.col("text"), ("Risk of", "Change"), {"Change": ("pipeline:",)}).alias("errors"))


@_query("""SELECT domain_id, CASE WHEN keywords IS NULL THEN [] ELSE list_filter(list_transform(range(0, len(keywords)), lambda i: CASE WHEN source IS NULL THEN 'concept_signals[' || i || ']: lacks source' END), lambda x: x IS NOT NULL) END
   || CASE WHEN description IS NULL THEN [] ELSE ['rule_signals: list expected'] END AS errors FROM domains""")
def signal_errors(spark: SparkSession, d: str) -> DataFrame:
    """Domains written as signal documents: a signal per keyword, and the description where a list is expected."""
    one = F.transform("keywords", lambda k: F.struct(F.coalesce(k, F.lit("")).alias("signal_type"), F.lit("seen").alias("evidence"), F.lit("low").alias("confidence"), F.col("source")))
    return validate.with_json(table(spark, d, "domains"), F.to_json(F.struct(one.alias("concept_signals"), F.col("description").alias("rule_signals")))).select("domain_id", validate.signal_errors(F.col("json")).alias("errors"))


@_query("""WITH c AS (SELECT unit_id, commit_id, theme, summary, op, importance, file_paths, CASE op WHEN 'feat' THEN 'feature' ELSE op END AS kind FROM change_units)
 SELECT unit_id, CASE WHEN commit_id IS NULL THEN 'commit_id: missing' WHEN theme IS NULL THEN 'module: missing' WHEN summary IS NULL THEN 'commit_log: missing' WHEN kind IS NULL THEN 'development_type: missing'
   WHEN file_paths IS NULL THEN 'rules: missing' WHEN kind NOT IN ('feature', 'bugfix', 'refactor', 'migration', 'optimize') THEN 'development_type: unknown value ' || kind
   WHEN kind = 'feature' THEN 'issue_text: must begin with feat：' WHEN kind <> 'bugfix' THEN 'issue_text: must begin with ' || kind || '：'
   WHEN importance IS DISTINCT FROM 'primary' THEN 'split_suggestion: reasons without a split'
   WHEN len(list_filter(file_paths, lambda p: contains(lower(p), 'code style'))) > 0 THEN 'holds for any software: ' || list_filter(file_paths, lambda p: contains(lower(p), 'code style'))[1] END AS failure FROM c""")
def case_failures(spark: SparkSession, d: str) -> DataFrame:
    """Units written as cases: what is wrong with each first."""
    kind = F.when(F.col("op") == "feat", "feature").otherwise(F.col("op"))
    split = F.struct((F.coalesce("importance", F.lit("")) == "primary").alias("needs_split"), F.array(F.lit("size")).alias("split_reasons"))
    case = F.struct(
        F.col("unit_id").alias("case_id"), "commit_id", F.col("theme").alias("module"), F.col("summary").alias("commit_log"), F.lit("bugfix：x").alias("issue_text"), kind.alias("development_type"),
        F.col("file_paths").alias("rules"), F.array().cast("array<string>").alias("invariants"), split.alias("split_suggestion"), F.lit("low").alias("value"),
    )
    return validate.with_json(table(spark, d, "change_units"), F.to_json(case)).select("unit_id", validate.case_failure(F.col("json")).alias("failure"))


@_query("""WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'merge' ELSE 'keep' END AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS t, o_totalprice > 100000 AS c, round(least(o_totalprice / 40000, 12), 1) AS s FROM orders)
 SELECT o_orderkey, list_filter([CASE WHEN a = 'merge' AND t IS NULL THEN 'merge without a target' END, CASE WHEN c AND t IS NULL THEN 'check without a gap' END, CASE WHEN s <> greatest(s, 5.0) THEN 'priority must be the largest score' END,
   CASE WHEN NOT s BETWEEN 1 AND 10 THEN 'score out of range' END], lambda x: x IS NOT NULL) AS errors FROM r""")
def cross_field_errors(spark: SparkSession, d: str) -> DataFrame:
    """Orders as decisions whose fields must agree."""
    target = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    s = F.round(F.least(F.col("o_totalprice") / 40000, F.lit(12.0)), 1)
    action = F.when(F.col("o_orderstatus") == "P", "merge").otherwise("keep")
    return table(spark, d, "orders").select("o_orderkey", F.concat(validate.cross_field_errors(action, target, F.col("o_totalprice") > 100000, target), validate.consistent_scores(s, s, F.lit(5.0))).alias("errors"))


@_query(r"""SELECT doc_id, NOT coalesce(contains(lower(text), 'listener'), false) AS lacks, coalesce(len(list_filter(string_split(text, chr(10)), lambda x: lower(trim(x)) = 'acceptance: true')) > 0, false) AS accepted,
   CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\s\x{0B}\x{85}\p{Z}\x{200B}]') AND length(regexp_replace(text, '[\s\x{0B}\x{85}\p{Z}]+', '', 'g')) = 0 THEN 'empty issue' END AS issue FROM documents""")
def text_checks(spark: SparkSession, d: str) -> DataFrame:
    """A word that must be there, a flag line, an issue that must not be empty."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", validate.lacks_keyword(t, "listener").alias("lacks"), validate.acceptance(t).alias("accepted"), validate.issue_error(t).alias("issue"))


# ---- scalars and extraction


@_query("""SELECT raw_id, sha256(array_to_string(list_sort(list_transform(range(1, len(files) + 1), lambda i: coalesce(files[i], '') || '=' || sha256(coalesce(diff_chunks[i], '')))), chr(10))) AS digest FROM raw_commits WHERE files IS NOT NULL AND diff_chunks IS NOT NULL AND len(files) > 0""")
def set_digests(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each commit's files with their chunks, whatever their order."""
    c = table(spark, d, "raw_commits").filter("size(files) > 0 and diff_chunks is not null")
    pairs = F.transform("files", lambda f, i: F.struct(F.coalesce(f, F.lit("")).alias("path"), F.coalesce(F.get("diff_chunks", i), F.lit("")).alias("text")))
    return c.select("raw_id", scoring.document_set_digest(pairs).alias("digest"))


@_query(r"""WITH t AS (SELECT doc_id, trim('```' || coalesce(doc_kind, '') || chr(10) || coalesce(text, '') || chr(10) || '```', E' \t\r\n') AS t FROM documents)
 SELECT doc_id, md5(trim(regexp_replace(t, '(?m)^[ \t]*```.*$\n?', '', 'g'), E' \t\r\n')) AS digest FROM t""")
def unfenced(spark: SparkSession, d: str) -> DataFrame:
    """Documents put in a code fence and taken out of it."""
    fenced = F.concat(F.lit("```"), F.coalesce("doc_kind", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n```"))
    return table(spark, d, "documents").select("doc_id", F.md5(extract.without_fences(fenced)).alias("digest"))


@_query("""WITH r AS (SELECT record_id, CASE WHEN json_valid(payload) THEN json_extract(payload, '$.shared_hints.aliases') END AS a FROM context_records),
 e AS (SELECT record_id, unnest(from_json(a, '["JSON"]')) AS x FROM r WHERE json_type(a) = 'ARRAY')
 SELECT record_id, count(*) AS n FROM e WHERE json_type(x) = 'OBJECT' AND x->>'canonical' IS NOT NULL AND x->>'alias' IS NOT NULL GROUP BY record_id""")
def tolerant_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects with all fields in the fenced alias lists of contexts."""
    fenced = F.concat(F.lit("```json\n"), F.get_json_object("payload", "$.shared_hints.aliases"), F.lit("\n```"))
    n = F.size(extract.json_objects(fenced, "struct<canonical: string, alias: string>", ["canonical", "alias"])).cast("bigint")
    return table(spark, d, "context_records").select("record_id", n.alias("n")).filter("n > 0")


@_query("""SELECT raw_id, coalesce(len(files), 0) * 7 + coalesce(len(diff_chunks), 0) + 500 * (raw_id % 3) AS weight FROM raw_commits""")
def stat_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weight of the change statistics of each commit, written out as text first."""
    n, m = F.coalesce(F.size("files"), F.lit(0)), F.coalesce(F.size("diff_chunks"), F.lit(0))
    ins = F.when(n > 0, F.format_string(", %d insertions(+)", n * 7)).otherwise("")
    dels = F.when(m > 0, F.format_string(", %d deletions(-)", m)).otherwise("")
    binary = F.repeat(F.lit(" a.png | Bin 10 -> 20 bytes\n"), (F.col("raw_id") % 3).cast("int"))
    return table(spark, d, "raw_commits").select("raw_id", scoring.stat_weight(F.concat(binary, F.format_string(" %d files changed", n), ins, dels)).alias("weight"))


@_query("""WITH s AS (SELECT doc_id, coalesce(strlen(text), 0) * 97 AS n FROM documents)
 SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024 * 10 + 0.5) / 10) WHEN n < 1073741824 THEN printf('%.1f MB', floor(n / 1048576 * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(n / 1073741824 * 10 + 0.5) / 10) END AS size FROM s""")
def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scoring.human_size(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") * 97).alias("size"))


@_query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
 c AS (SELECT c_custkey, c_name, coalesce(n, 0) AS n, CASE WHEN c_acctbal > 6000 THEN 'high' WHEN c_acctbal > 0 THEN 'medium' ELSE 'low' END AS conf FROM customer LEFT JOIN o ON o_custkey = c_custkey),
 v AS (SELECT *, conf = 'high' OR (conf = 'medium' AND n > 0) AS ok, round(least(CASE conf WHEN 'high' THEN 8.0 WHEN 'medium' THEN 6.0 ELSE 3.0 END + least(n * 0.5, 2.0), 10.0), 1) AS b, CASE conf WHEN 'high' THEN 8.0 WHEN 'medium' THEN 6.0 ELSE 3.0 END AS w FROM c)
 SELECT c_custkey, CASE conf WHEN 'high' THEN 'high confidence' WHEN 'low' THEN 'low confidence' ELSE CASE WHEN n > 0 THEN 'medium confidence, with evidence' ELSE 'medium confidence, no evidence' END END AS reason,
   CASE WHEN ok THEN list_filter(['valid', CASE WHEN conf = 'high' THEN 'high confidence' END, CASE WHEN n > 0 THEN n || ' references' END, CASE WHEN b >= 7 THEN 'business score' END, CASE WHEN w >= 7 THEN 'value score' END], lambda x: x IS NOT NULL) ELSE [] END AS pro,
   CASE WHEN ok THEN [] ELSE list_filter(['not valid', CASE WHEN conf = 'low' THEN 'low confidence' END, CASE WHEN n = 0 THEN 'no evidence' END], lambda x: x IS NOT NULL) END AS contra,
   CASE WHEN ok AND conf = 'medium' AND n < 2 THEN 'medium confidence on little evidence' WHEN ok AND conf = 'high' AND n = 0 THEN 'high confidence without evidence' END AS gap FROM v""")
def reasons(spark: SparkSession, d: str) -> DataFrame:
    """Customers as candidates: why they are valid or not, and what is to be verified."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").join(orders, "c_custkey", "left").withColumn("conf", F.when(F.col("c_acctbal") > 6000, "high").when(F.col("c_acctbal") > 0, "medium").otherwise("low")).withColumn("n", F.coalesce("n", F.lit(0)))
    conf, n = F.col("conf"), F.col("n")
    v = scoring.valid(conf, n, F.col("c_name"))
    pro, contra = scoring.reasons(v, conf, n, *scoring.scores(conf, n, F.lit(0)))
    return c.select("c_custkey", scoring.validity_reason(conf, n, {"name": F.col("c_name")}).alias("reason"), pro.alias("pro"), contra.alias("contra"), scoring.evidence_gap(v, conf, n).alias("gap"))


@_query("""SELECT domain_id, CASE WHEN repo_id % 3 = 0 AND len(paths) > 0 THEN paths WHEN repo_id % 3 = 1 AND len(keywords) > 0 THEN list_filter(list_transform(range(1, len(keywords) + 1), lambda i: CASE WHEN i = list_position(keywords, keywords[i]) THEN {'v': keywords[i]} END), lambda x: x IS NOT NULL).list_transform(lambda x: x.v)
   ELSE CASE WHEN regexp_matches(lower(coalesce(description, '')), 'must|always|never|required|cannot|should not') THEN [description] ELSE [] END END AS kept FROM domains
   WHERE len(list_filter(coalesce(keywords, []), lambda k: k IS NULL)) = 0 OR repo_id % 3 <> 1""")
def invariant_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Stated invariants, those of models, or normative rules: paths, keywords and descriptions stand for them."""
    m = table(spark, d, "domains").filter("not exists(coalesce(keywords, array()), k -> k is null) or repo_id % 3 <> 1")
    own = lambda k, c: F.when(F.col("repo_id") % 3 == k, F.col(c))
    return m.select("domain_id", scoring.invariants(own(0, "paths"), own(1, "keywords"), F.filter(F.array("description"), lambda x: x.isNotNull())).alias("kept"))


@_query(r"""WITH n AS (SELECT domain_id, list_filter(regexp_split_to_array(domain_name, '[^A-Za-z0-9]+'), lambda w: w <> '') AS ws FROM domains WHERE domain_name IS NOT NULL),
 p AS (SELECT domain_id, array_to_string(list_transform(ws, lambda w: upper(w[1]) || w[2:]), '') AS pascal FROM n)
 SELECT domain_id, pascal, lower(pascal[1]) || pascal[2:] AS camel FROM p""")
def export_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "domains").filter("domain_name is not null")
    return n.select("domain_id", writers.pascal(F.col("domain_name")).alias("pascal"), writers.camel(F.col("domain_name")).alias("camel"))


# ---- SQL of queries that stand in the catalogue

_LINES = "string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))"
SQL |= {
    "sections": rf"""WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text IS NOT NULL),
 h AS (SELECT doc_id, len(ls) AS n, list_concat([{{'i': -1, 't': ''}}], list_filter(list_transform(range(0, len(ls)), lambda i: {{'i': i, 't': regexp_extract(ls[i + 1], '^#{{1,6}}\s+(.+?)\s*$', 1)}}), lambda x: x.t <> '')) AS h FROM l),
 e AS (SELECT doc_id, n, h, unnest(range(0, len(h))) AS k FROM h)
 SELECT doc_id, k AS section_no, h[k + 1].t AS title, coalesce(h[k + 2].i, n) - h[k + 1].i - 1 AS n_lines FROM e""",
    "repeated_sections": rf"""WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(ls) AS x FROM l),
 h AS (SELECT doc_id, regexp_extract(x, '^#{{1,6}}\s+(.+?)\s*$', 1) AS title FROM t), u AS (SELECT doc_id, title FROM h WHERE title <> '' GROUP BY doc_id, title HAVING count(*) = 1)
 SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id""",
    "low_confidence": r"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS ls FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)
 SELECT DISTINCT doc_id, CASE WHEN i > 1 AND trim(ls[i - 1]) <> '' THEN trim(ls[i - 1]) ELSE trim(ls[i]) END AS context FROM p WHERE contains(lower(ls[i]), 'confidence') AND contains(lower(ls[i]), 'low')""",
    "fact_errors": """WITH f AS (SELECT unit_id, CASE WHEN lower(op) IN ('config', 'compat') THEN 'dependency_rule' WHEN lower(op) = 'test' THEN 'invariant' ELSE op END AS ft, summary, importance, file_paths FROM change_units),
 e AS (SELECT CASE WHEN unit_id IS NULL OR ft IS NULL OR summary IS NULL OR importance IS NULL OR file_paths IS NULL THEN 'missing fields'
   WHEN ft NOT IN ('module_role', 'dependency_rule', 'convention', 'pattern_usage', 'invariant', 'hotspot_signal') THEN 'invalid fact_type: ' || ft
   WHEN len(list_filter(file_paths, lambda p: p IS NULL OR p = '')) > 0 THEN 'missing locator' END AS error FROM f)
 SELECT error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY error""",
    "card_errors": """WITH c AS (SELECT domain_id, repo_id, domain_name AS i, description AS t, keywords AS k, paths AS p, CASE source WHEN 'hotspot' THEN 'bugfix' ELSE source END AS dt FROM domains),
 e AS (SELECT domain_id, flatten([
   CASE WHEN trim(coalesce(i, ''), E' \t\r\n') = '' THEN ['demand_card.request_source.issue_id: text expected'] ELSE [] END, CASE WHEN trim(coalesce(t, ''), E' \t\r\n') = '' THEN ['demand_card.request_source.issue_text: text expected'] ELSE [] END,
   CASE WHEN repo_id < 5 THEN ['demand_card.mapping.owner: unknown field'] ELSE [] END,
   CASE WHEN k IS NULL THEN ['demand_card.mapping.domains: list expected'] ELSE list_filter(list_transform(range(0, len(k)), lambda j: CASE WHEN trim(coalesce(k[j + 1], ''), E' \t\r\n') = '' THEN 'demand_card.mapping.domains[' || j || ']: text expected' END), lambda x: x IS NOT NULL) END,
   CASE WHEN p IS NULL THEN ['demand_card.mapping.concepts: list expected'] ELSE list_filter(list_transform(range(0, len(p)), lambda j: CASE WHEN trim(coalesce(p[j + 1], ''), E' \t\r\n') = '' THEN 'demand_card.mapping.concepts[' || j || ']: text expected' END), lambda x: x IS NOT NULL) END,
   CASE WHEN coalesce(repo_id > 20, false) THEN [] ELSE ['demand_card.mapping.invariants: list expected'] END,
   CASE WHEN coalesce(repo_id <> 7, false) THEN [] ELSE ['demand_card.uncertainties: object expected'] END,
   CASE WHEN coalesce(dt, '') IN ('feature', 'bugfix', 'refactor', 'migration', 'optimize') THEN [] ELSE ['demand_card.development_type: not an allowed value'] END]) AS errors FROM c)
 SELECT domain_id, errors FROM e""",
    "context_modes": """WITH j AS (SELECT CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM context_records),
 r AS (SELECT json_extract(p, '$.summary') AS s, json_extract_string(p, '$.summary.bootstrap_status') AS st, json_extract_string(p, '$.summary.fingerprint') AS fp,
   coalesce(json_array_length(p, '$.shared_hints.local_capabilities'), 0) + coalesce(json_array_length(p, '$.shared_hints.aliases'), 0) AS hints FROM j),
 m AS (SELECT CASE WHEN s IS NULL OR json_type(s) = 'NULL' THEN 'bypass:invalid-context' WHEN NOT coalesce(fp[1] < 'c', false) THEN 'bypass:stale-context' WHEN coalesce(st, '') NOT IN ('full', 'degraded', 'bypass') THEN 'bypass:invalid-bootstrap-status'
   WHEN st = 'bypass' THEN 'bypass' WHEN hints = 0 THEN 'degraded:empty-shared-hints' WHEN st = 'degraded' THEN 'degraded' ELSE 'full' END AS mode FROM r)
 SELECT mode, count(*) AS n FROM m GROUP BY mode""",
    "doc_facts": r"""WITH t AS (SELECT doc_id, text FROM documents WHERE length(trim(text)) >= 20),
 k AS (SELECT doc_id, list_concat(regexp_extract_all(text, '`([A-Z][a-zA-Z0-9_]+)`', 1), regexp_extract_all(text, 'class\s+([A-Z][a-zA-Z0-9_]+)', 1), regexp_extract_all(text, 'def\s+([a-z][a-zA-Z0-9_]+)', 1)) AS s,
   list_concat(regexp_extract_all(text, '`([a-z_/]+\.py)`', 1), regexp_extract_all(text, '((?:src|tests|lib)/[a-z_/]+\.py)', 1)) AS f, regexp_extract_all(text, '`([a-z_][a-zA-Z0-9_]*)`', 1) AS c,
   regexp_extract_all(text, '(?:class|function)\s+(\w+)', 1) AS a, list_filter(regexp_extract_all(text, '(?:def |test_)([a-z_][a-zA-Z0-9_]*)', 1), lambda x: contains(lower(x), 'test')) AS e FROM t),
 u AS (SELECT doc_id, 'symbol' AS locator_type, list_filter(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN list_position(s, s[i]) = i THEN s[i] END), lambda x: x IS NOT NULL) AS v FROM k
   UNION ALL SELECT doc_id, 'file_path', list_filter(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN list_position(f, f[i]) = i THEN f[i] END), lambda x: x IS NOT NULL) FROM k
   UNION ALL SELECT doc_id, 'config_key', list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN list_position(c, c[i]) = i AND NOT list_contains(s, c[i]) THEN c[i] END), lambda x: x IS NOT NULL) FROM k
   UNION ALL SELECT doc_id, 'ast_pattern', a FROM k UNION ALL SELECT doc_id, 'test_case', e FROM k)
 SELECT doc_id, locator_type, unnest(list_slice(v, 1, 5)) AS locator FROM u""",
    "card_concepts": r"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS ls FROM documents WHERE doc_kind = 'demand_card' AND text IS NOT NULL),
 a AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(trim(x), '(?i)^[-*]?\s*concepts\s*:\s*$')), true) AS pos FROM l),
 b AS (SELECT doc_id, list_filter(list_slice(ls, pos + 1, len(ls)), lambda x: trim(x) <> '') AS bl FROM a WHERE pos > 0),
 s AS (SELECT doc_id, bl, list_position(list_transform(bl, lambda x: regexp_matches(x, '^\s*[-*]\s+.+$')), false) AS stop FROM b),
 r AS (SELECT doc_id, list_filter(list_transform(CASE WHEN stop > 0 THEN list_slice(bl, 1, stop - 1) ELSE bl END, lambda x: trim(regexp_extract(x, '^\s*[-*]\s+(.+)$', 1))), lambda x: x <> '') AS c FROM s)
 SELECT doc_id, list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN list_position(list_transform(c, lambda y: lower(y)), lower(c[i])) = i THEN c[i] END), lambda x: x IS NOT NULL) AS concepts FROM r WHERE len(c) > 0""",
    "section_bodies": r"""WITH h AS (SELECT doc_id, regexp_replace(text, '(?m)^(##\s+)', chr(1) || '\1', 'g') AS t FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS ps FROM h), e AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p),
 q AS (SELECT doc_id, i - 1 AS section_no, ps[i] AS p, split_part(ps[i], chr(10), 1) AS f FROM e),
 b AS (SELECT doc_id, section_no, CASE WHEN starts_with(p, '## ') THEN trim(substr(f, 4), E' \t\r\n') ELSE substr(f, 1, 50) END AS title,
   CASE WHEN NOT starts_with(p, '## ') THEN p WHEN contains(p, chr(10)) THEN trim(substr(p, position(chr(10) IN p) + 1), E' \t\r\n') ELSE '' END AS content FROM q)
 SELECT doc_id, section_no, title, length(content) AS chars FROM b WHERE length(content) >= 20""",
}
