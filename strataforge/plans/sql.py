"""SQL of the core's queries, in DuckDB's dialect, over whole tables. Queries that need NFKC, an AST, an order-dependent
fold over merged records or the parsing rules of timestamps have none; tests hold them against brute force."""

from __future__ import annotations

_OPS = "['feat','bugfix','refactor','optimize','cleanup','config','docs','test','compat','safety','other']"
_NOISE = "'misc','other','others','general','generic','unknown','uncategorized'"
_TOK = "list_distinct(regexp_extract_all(translate(lower(coalesce({c}, '')), '-_/', '   '), '[a-z0-9_]+'))"

_DIMS = f"""
 named AS (SELECT repo_id, lower(trim(domain_name)) AS name, domain_id, paths, keywords FROM domains
   WHERE trim(coalesce(domain_name, '')) <> '' AND lower(trim(domain_name)) NOT IN ({_NOISE})),
 dims AS (SELECT n.* FROM named n JOIN (SELECT repo_id, name, min(domain_id) AS domain_id FROM named GROUP BY ALL) f USING (repo_id, name, domain_id)),
 prefixes AS (SELECT repo_id, name, domain_id, p FROM (SELECT repo_id, name, domain_id, unnest(paths) AS p FROM dims) WHERE p <> '')"""

_UNITS = """
 u AS (SELECT unit_id, commit_id, repo_id, file_paths, trim(summary) AS summary, coalesce(nullif(lower(trim(theme)), ''), 'unknown') AS theme,
   coalesce(nullif(lower(trim(op)), ''), 'other') AS op, coalesce(nullif(lower(trim(importance)), ''), 'secondary') AS importance FROM change_units)"""

_PHRASED = """
 p AS (SELECT doc_id, source, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents),
 q AS (SELECT * FROM p WHERE key <> '')"""


def _fuzzy() -> str:
    return r"""
 r AS (SELECT domain_id AS id, repo_id, lower(trim(coalesce(domain_name, ''))) AS name,
   list_sort(list_distinct(list_filter(list_transform(coalesce(keywords, []), lambda x: lower(trim(x))), lambda x: x <> ''))) AS kw,
   list_sort(list_distinct(list_filter(coalesce(paths, []), lambda x: x <> ''))) AS pa FROM domains),
 reps AS (SELECT repo_id, name, kw, pa, min(id) AS id FROM r WHERE name <> '' GROUP BY repo_id, name, kw, pa),
 pairs AS (SELECT a.id AS left_id, b.id AS right_id FROM reps a JOIN reps b ON a.repo_id = b.repo_id AND a.id < b.id
   WHERE a.name = b.name OR a.name || 's' = b.name OR b.name || 's' = a.name
   OR (len(list_intersect(a.kw, b.kw)) >= 2 AND 2 * len(list_intersect(a.kw, b.kw)) >= least(len(a.kw), len(b.kw)))
   OR (len(a.pa) > 0 AND len(b.pa) > 0 AND 5 * len(list_intersect(a.pa, b.pa)) >= 3 * least(len(a.pa), len(b.pa))))"""


def _phrase_rank() -> str:
    return r"""
 cands(i, name, aliases) AS (VALUES (0, 'audit trail', ['log of the changes']), (1, 'court fee', []), (2, 'grade book', ['exam sheet']), (3, 'gives_up', []),
   (4, 'cold chain', ['truck fleet', 'loading ramp']), (5, 'lab result', []), (6, 'no behaviour changes', []), (7, 'old demo', ['stays off'])),
 c AS (SELECT i, name, list_transform(list_concat([name, replace(name, '_', ' ')], aliases), lambda a: trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g'))) AS alts,
   list_distinct(regexp_extract_all(lower(name), '[a-z0-9_]+')) AS toks FROM cands),
 t AS (SELECT doc_id, lower(text) AS low, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS ph,
   list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS toks FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, i, name,
   (CASE WHEN contains(low, name) OR contains(ph, ' ' || alts[1] || ' ') THEN 100 ELSE 0 END)
   + (CASE WHEN len(list_filter(alts, lambda a: contains(a, ' ') AND contains(ph, ' ' || a || ' '))) > 0 THEN 60 ELSE 0 END)
   + len(list_intersect(t.toks, c.toks)) AS score FROM t CROSS JOIN c)"""


def _bugwords(words: str) -> str:
    return rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


_KINDS = f"""list_filter([
  CASE WHEN {_bugwords('bug|fix|error|crash|regression|fail|failure|failing|broken')} THEN 'bugfix' END,
  CASE WHEN {_bugwords('migrate|migration|upgrade|port|replace|move to')} THEN 'migration' END,
  CASE WHEN {_bugwords('refactor|restructure|cleanup|reorganize|rename')} THEN 'refactor' END,
  CASE WHEN {_bugwords('optimise|optimize|performance|latency|throughput|cpu|memory|overhead|faster')} THEN 'optimize' END,
  CASE WHEN {_bugwords('add|introduce|new|implement|support|create')} THEN 'feature' END], lambda x: x IS NOT NULL)"""

SQL: dict[str, str] = {
    "classify_scored": f"""WITH {_DIMS},
 du AS (SELECT repo_id, name, list_distinct(list_concat({_TOK.format(c="name")}, flatten(list_transform(coalesce(keywords, []), lambda k: {_TOK.format(c="k")})))) AS sig,
   flatten(list_transform(coalesce(keywords, []), lambda k: {_TOK.format(c="k")})) AS kw, list_filter(coalesce(paths, []), lambda x: x <> '') AS pre FROM dims),
 uu AS (SELECT unit_id, repo_id, {_TOK.format(c="theme")} AS th, {_TOK.format(c="summary")} AS su, {_TOK.format(c="section_name")} AS se, list_filter(coalesce(file_paths, []), lambda x: x <> '') AS fp FROM change_units),
 sc AS (SELECT unit_id, name,
   (CASE WHEN len(list_filter(fp, lambda f: len(list_filter(pre, lambda p: starts_with(f, p))) > 0)) > 0 THEN 5 ELSE 0 END)
   + (CASE WHEN list_has_any(sig, th) THEN 3 ELSE 0 END) + (CASE WHEN list_has_any(sig, su) THEN 2 ELSE 0 END) + (CASE WHEN list_has_any(sig, se) THEN 2 ELSE 0 END)
   + (CASE WHEN list_has_any(kw, list_concat(th, su, se)) THEN 1 ELSE 0 END) AS score FROM uu JOIN du USING (repo_id)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, name) AS rn, lead(score) OVER (PARTITION BY unit_id ORDER BY score DESC, name) AS nxt FROM sc),
 top AS (SELECT unit_id, name, score, coalesce(nxt, 0) AS second FROM rk WHERE rn = 1)
 SELECT c.unit_id, CASE WHEN score >= 4 AND score - second >= 2 THEN name END AS name, coalesce(score, 0) AS score, coalesce(second, 0) AS second FROM change_units c LEFT JOIN top USING (unit_id)""",
    "prefix_assign": f"""WITH {_DIMS},
 f AS (SELECT DISTINCT unit_id, repo_id, p AS path FROM (SELECT unit_id, repo_id, unnest(file_paths) AS p FROM change_units) WHERE p <> ''),
 m AS (SELECT unit_id, path, arg_max(name, length(p) * 1000000000 - domain_id) AS name FROM f JOIN prefixes x ON x.repo_id = f.repo_id AND starts_with(f.path, x.p) GROUP BY unit_id, path),
 w AS (SELECT unit_id, min(name) AS lo, max(name) AS hi FROM m GROUP BY unit_id)
 SELECT c.unit_id, CASE WHEN lo = hi THEN lo END AS name FROM change_units c LEFT JOIN w USING (unit_id)""",
    "fuzzy_pairs": f"WITH {_fuzzy()} SELECT left_id, right_id FROM pairs",
    "record_classes": f"""WITH {_fuzzy()}, named AS (SELECT * FROM r WHERE name <> ''),
 links AS (SELECT a.id, count(*) AS n FROM named a JOIN named b ON a.repo_id = b.repo_id AND a.id <> b.id
   WHERE a.name = b.name OR a.name || 's' = b.name OR b.name || 's' = a.name
   OR (len(list_intersect(a.kw, b.kw)) >= 2 AND 2 * len(list_intersect(a.kw, b.kw)) >= least(len(a.kw), len(b.kw)))
   OR (len(a.pa) > 0 AND len(b.pa) > 0 AND 5 * len(list_intersect(a.pa, b.pa)) >= 3 * least(len(a.pa), len(b.pa))) GROUP BY a.id)
 SELECT id AS domain_id, CASE WHEN repo_id IS NULL THEN id ELSE min(id) OVER (PARTITION BY repo_id, name, kw, pa) END AS class_id, coalesce(links.n, 0) AS n_links FROM named LEFT JOIN links USING (id)""",
    "phrase_rank": f"WITH {_phrase_rank()} SELECT doc_id, name AS candidate, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank FROM s WHERE score > 0",
    "resume_anti": "SELECT raw_id, commit_id FROM raw_commits r WHERE NOT EXISTS (SELECT 1 FROM change_units u WHERE u.commit_id = r.commit_id)",
    "snapshot_diff": """WITH c AS (SELECT commit_id, raw_id, ingested_at, sha256(concat_ws(chr(10), array_to_string(files, chr(10)), array_to_string(diff_chunks, chr(10)), coalesce(author, ''))) AS digest FROM raw_commits WHERE commit_id IS NOT NULL),
 o AS (SELECT commit_id, digest FROM c QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY ingested_at, raw_id) = 1),
 l AS (SELECT commit_id, digest FROM c QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY ingested_at DESC, raw_id DESC) = 1),
 n AS (SELECT DISTINCT u.commit_id, l.digest FROM change_units u LEFT JOIN l USING (commit_id) WHERE u.commit_id IS NOT NULL)
 SELECT coalesce(o.commit_id, n.commit_id) AS commit_id, CASE WHEN o.commit_id IS NULL THEN 'added' WHEN n.commit_id IS NULL THEN 'removed' WHEN o.digest = n.digest THEN 'unchanged' ELSE 'changed' END AS status
 FROM o FULL JOIN n ON o.commit_id = n.commit_id""",
    "cache_hits": """WITH t AS (SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS digest, written_at FROM documents)
 SELECT doc_id, digest, coalesce(written_at < TIMESTAMP '2023-01-01' AND written_at >= TIMESTAMP '2023-01-01' - INTERVAL 8760 HOUR, false) AS hit FROM t""",
    "index_consistency": """WITH i AS (SELECT DISTINCT commit_id FROM change_units WHERE commit_id IS NOT NULL),
 f AS (SELECT commit_id, bool_or(coalesce(len(diff_chunks), 0) > 0) AS ok FROM raw_commits WHERE commit_id IS NOT NULL GROUP BY commit_id)
 SELECT coalesce(i.commit_id, f.commit_id) AS commit_id, CASE WHEN f.commit_id IS NULL THEN 'missing' WHEN i.commit_id IS NULL THEN 'orphaned' ELSE 'corrupt' END AS problem
 FROM i FULL JOIN f ON i.commit_id = f.commit_id WHERE f.commit_id IS NULL OR i.commit_id IS NULL OR NOT ok""",
    "context_precedence": """WITH r AS (SELECT repo_id, record_id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.summary.bootstrap_status') END AS status FROM context_records WHERE repo_id IS NOT NULL)
 SELECT repo_id, record_id, status FROM r WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY status <> 'full', record_id DESC) = 1""",
    "model_hints": """SELECT doc_id, CASE WHEN contains(lower(text), 'gives up') THEN 'bugfix' WHEN contains(lower(text), 'no longer imports') THEN 'refactor'
   WHEN contains(lower(text), 'after the') OR contains(lower(text), 'was cached') THEN 'optimize' WHEN contains(lower(text), 'users asked') THEN 'feature' END AS hint FROM documents WHERE text IS NOT NULL""",
    "term_lines": r"""WITH s AS (SELECT DISTINCT split_part(repo_name, '-', 1) AS symbol FROM repos),
 l AS (SELECT doc_id, i - 1 AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
 w AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(line, '[0-9A-Za-z_]+')) AS symbol FROM l)
 SELECT symbol, doc_id, line_no FROM w JOIN s USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY doc_id, line_no) <= 3""",
    "dedup_first": f"WITH {_PHRASED} SELECT doc_id, row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1 AS kept FROM q",
    "dedup_last": "SELECT commit_id, raw_id, author FROM raw_commits WHERE commit_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY ingested_at DESC NULLS LAST, raw_id DESC) = 1",
    "canonical_cases": f"""WITH c AS (SELECT unit_id, unnest(list_distinct(list_transform(CASE WHEN len(list_filter(coalesce(file_paths, []), lambda p: p IS NOT NULL)) > 0 THEN list_filter(file_paths, lambda p: p IS NOT NULL) ELSE [''] END,
   lambda p: CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE 'root' END))) AS module, lower(trim(op)) AS op,
   trim(regexp_replace(lower(regexp_replace(summary, '[0-9]+', '0', 'g')), '[^a-z0-9]+', ' ', 'g')) AS issue, CASE WHEN lower(trim(importance)) = 'primary' THEN 0 ELSE 2 END AS r, abs(length(summary) - 18) AS dist
   FROM change_units WHERE summary IS NOT NULL AND op IS NOT NULL)
 SELECT module, op, issue, unit_id, cases FROM (SELECT *, count(*) OVER (PARTITION BY module, op, issue) AS cases, row_number() OVER (PARTITION BY module, op, issue ORDER BY r, dist, unit_id) AS rn FROM c) WHERE rn = 1""",
    "hotspot_topk": """WITH f AS (SELECT raw_id, i, files[i] AS p FROM (SELECT raw_id, files, unnest(range(1, len(files) + 1)) AS i FROM raw_commits) WHERE files[i] IS NOT NULL),
 g AS (SELECT CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE 'root' END AS module, count(*) AS touches, count(DISTINCT p) AS files, min(raw_id * 1000000 + i) AS seen FROM f GROUP BY 1),
 k AS (SELECT *, row_number() OVER (ORDER BY touches DESC, seen) AS rank FROM g)
 SELECT module, touches, files, rank FROM k WHERE rank <= 10 AND touches >= 2""",
    "distribution": f"WITH {_UNITS} SELECT op AS value, count(*) AS n FROM u GROUP BY op ORDER BY n DESC, min(unit_id) LIMIT 30",
    "theme_distribution": f"WITH {_UNITS} SELECT theme AS value, count(*) AS n FROM u GROUP BY theme ORDER BY n DESC, min(unit_id) LIMIT 30",
    "representatives": f"""WITH {_UNITS}, f AS (SELECT theme AS grp, unit_id, summary FROM u WHERE coalesce(summary, '') <> '' QUALIFY row_number() OVER (PARTITION BY theme ORDER BY unit_id) = 1)
 SELECT grp, summary FROM f ORDER BY unit_id LIMIT 5""",
    "health_metrics": f"""WITH {_UNITS}, h AS (SELECT coalesce(len(file_paths), 0) >= 3 AS mixed, length(summary) < 60 AS low, coalesce(len(file_paths), 0) >= 2 AND commit_id IS NOT NULL AS stable,
   theme <> 'unknown' AS covered, NOT contains(lower(summary), string_split(theme, ' ')[-1]) AS drifted FROM u)
 SELECT count(*) AS candidates, count_if(stable) AS stable, coalesce(round(count_if(mixed) / nullif(count(*), 0), 4), 0) AS mixed_ratio, coalesce(round(count_if(low) / nullif(count(*), 0), 4), 0) AS low_signal_ratio,
   coalesce(round(count_if(stable AND covered) / nullif(count_if(stable), 0), 4), 0) AS evidence_coverage, count_if(drifted) AS naming_drift FROM h""",
    "feedback_pivot": f"""WITH {_UNITS}, o AS (SELECT importance, CASE WHEN op IN ('feat', 'bugfix') THEN 'accepted' WHEN op IN ('cleanup', 'docs') THEN 'rejected' ELSE 'other' END AS outcome FROM u)
 SELECT importance, count_if(outcome = 'accepted') AS accepted, count_if(outcome = 'rejected') AS rejected, count_if(outcome = 'other') AS other, count(*) AS total,
   round(100 * round(count_if(outcome = 'accepted') / count(*), 6), 1) AS rate FROM o GROUP BY importance""",
    "conflicts": f"WITH {_PHRASED} SELECT min(doc_id) AS first_id, count(*) AS n_rows, count(DISTINCT coalesce(source, '')) AS n_sources FROM q GROUP BY key HAVING count(*) >= 2 AND count(DISTINCT coalesce(source, '')) > 1",
    "adjudicated": f"""WITH {_UNITS}, a AS (SELECT coalesce(len(file_paths), 0) - 1 AS n, lower(summary) AS s FROM u)
 SELECT CASE WHEN n >= 2 THEN 'evidence_backed' WHEN n = 1 THEN 'weakly_backed' WHEN contains(s, 'must') OR contains(s, 'shall') THEN 'drift' ELSE 'gap' END AS status, count(*) AS n FROM a GROUP BY 1""",
    "signals": "SELECT doc_kind, count(*) AS n, coalesce(doc_kind, 'none') || ': ' || count(*) || ' entries' AS summary FROM documents GROUP BY doc_kind",
    "cache_stats": "SELECT count(*) AS entries, coalesce(sum(coalesce(strlen(text), 0)), 0)::BIGINT AS bytes, 100 * round(count_if(written_at IS NOT NULL) / count(*), 6) AS hit_rate FROM documents",
    "theme_patterns": f"WITH {_UNITS} SELECT theme, count(*) AS n, count(DISTINCT commit_id) AS distinct_commits, round(count_if(importance = 'primary') / count(*), 4) AS primary_ratio, count(DISTINCT commit_id) >= 3 AS frequent FROM u GROUP BY theme",
    "op_distribution": f"WITH {_UNITS} SELECT theme, op, count(*) AS n FROM u GROUP BY theme, op",
    "demand_score": f"""WITH {_UNITS} SELECT theme, count(DISTINCT commit_id) AS distinct_commits, round(count(DISTINCT commit_id) * avg(CASE WHEN importance = 'primary' THEN 2.0 ELSE 1.0 END), 4) AS score
 FROM u GROUP BY theme ORDER BY score DESC, distinct_commits DESC, theme LIMIT 50""",
    "unit_summary": f"""WITH {_UNITS}, a AS (SELECT commit_id, min(ingested_at) AS at0 FROM raw_commits WHERE commit_id IS NOT NULL GROUP BY 1), o(i, op) AS (SELECT i, ({_OPS})[i] FROM range(1, 12) t(i)),
 n AS (SELECT list(op || '=' || (SELECT count(*) FROM u WHERE u.op = o.op) ORDER BY i) AS ops FROM o)
 SELECT count(*) AS total_units, count(DISTINCT theme) AS total_patterns, round(count_if(op = 'bugfix') / count(*), 4) AS bugfix_ratio, any_value(ops) AS ops, epoch_us(min(at0)) AS first_us, epoch_us(max(at0)) AS last_us
 FROM u LEFT JOIN a USING (commit_id) CROSS JOIN n""",
    "repo_bands": f"WITH {_UNITS} SELECT repo_id, count(DISTINCT theme) AS themes, CASE WHEN count(DISTINCT theme) = 0 THEN 'none' WHEN count(DISTINCT theme) < 3 THEN 'sparse' WHEN count(DISTINCT theme) < 10 THEN 'usual' ELSE 'dense' END AS band FROM u GROUP BY repo_id",
    "change_buckets": """SELECT CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'deferred' WHEN 'P' THEN 'needs_evidence' ELSE 'rejected' END AS outcome, count(*) AS n, round(max(o_totalprice), 2) AS largest FROM orders GROUP BY 1""",
    "batches": """WITH RECURSIVE w AS (SELECT repo_id, CAST(ingested_at AS DATE) AS day, raw_id, coalesce(list_sum(list_transform(diff_chunks, lambda x: coalesce(length(x), 0))), 0)::BIGINT AS w FROM raw_commits),
 o AS (SELECT *, row_number() OVER (PARTITION BY repo_id, day ORDER BY raw_id) AS rn FROM w),
 f AS (SELECT repo_id, day, raw_id, rn, 0::BIGINT AS batch, CASE WHEN w > 3000 THEN 0 ELSE w END AS cw, CASE WHEN w > 3000 THEN 0 ELSE 1 END AS cn, w > 3000 AS closed FROM o WHERE rn = 1
   UNION ALL
   SELECT o.repo_id, o.day, o.raw_id, o.rn,
     f.batch + CASE WHEN o.w <= 3000 AND NOT f.closed AND f.cw + o.w <= 3000 AND f.cn < 15 THEN 0 ELSE 1 END,
     CASE WHEN o.w > 3000 THEN 0 WHEN NOT f.closed AND f.cw + o.w <= 3000 AND f.cn < 15 THEN f.cw + o.w ELSE o.w END,
     CASE WHEN o.w > 3000 THEN 0 WHEN NOT f.closed AND f.cw + o.w <= 3000 AND f.cn < 15 THEN f.cn + 1 ELSE 1 END, o.w > 3000
   FROM f JOIN o ON o.repo_id IS NOT DISTINCT FROM f.repo_id AND o.day IS NOT DISTINCT FROM f.day AND o.rn = f.rn + 1)
 SELECT repo_id, day, raw_id, batch FROM f""",
    "latest_version": """WITH f AS (SELECT stream_id, context_key, file_seq, min(record_id) AS record_id, max(coalesce(length(payload), 0)) AS b FROM context_records GROUP BY ALL)
 SELECT stream_id, context_key, file_seq, record_id FROM f WHERE b > 0 QUALIFY row_number() OVER (PARTITION BY stream_id, context_key ORDER BY file_seq DESC) = 1""",
    "latest_valid_version": """WITH f AS (SELECT stream_id, context_key, file_seq, max(coalesce(length(payload), 0)) AS b, max(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.summary.fingerprint') END) AS fp FROM context_records GROUP BY ALL)
 SELECT stream_id, context_key, file_seq FROM f WHERE b > 0 AND fp IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stream_id, context_key ORDER BY file_seq DESC) = 1""",
    "retention": """WITH f AS (SELECT stream_id, file_seq, count(*) AS n FROM context_records WHERE stream_id IS NOT NULL GROUP BY ALL)
 SELECT stream_id, file_seq, row_number() OVER (PARTITION BY stream_id ORDER BY file_seq DESC) <= 3 OR n >= 12 AS keep FROM f""",
    "ttl_live": "SELECT event_id FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 72 HOUR - INTERVAL 1800 SECOND",
    "lru_evict": "SELECT domain_id FROM domains QUALIFY row_number() OVER (ORDER BY seen_at DESC NULLS LAST, domain_id DESC) > 500",
    "arbitrate": r"""WITH r AS (SELECT domain_id, repo_id, substr(description, 1, 80) AS head, CASE source WHEN 'architect' THEN 0 WHEN 'hotspot' THEN 1 WHEN 'codebase' THEN 2 ELSE 99 END AS r0, (seen_at IS NULL)::INT AS r1,
   list_distinct(list_filter(regexp_split_to_array(lower(trim(description)), '\s+'), lambda w: w <> '')) AS ws FROM domains WHERE trim(description) <> '' AND repo_id IS NOT NULL),
 b AS (SELECT repo_id, head, domain_id AS winner_id, ws AS bw FROM r QUALIFY row_number() OVER (PARTITION BY repo_id, head ORDER BY r0, r1, domain_id) = 1)
 SELECT domain_id, winner_id, CASE WHEN domain_id = winner_id THEN 'winner' WHEN coalesce(len(list_intersect(ws, bw)) / nullif(greatest(len(ws), len(bw)), 0), 0) < 0.3 THEN 'kept' ELSE 'dropped' END AS outcome
 FROM r JOIN b USING (repo_id, head)""",
    "errors_array": """WITH e AS (SELECT unit_id, list_filter([
   CASE WHEN trim(coalesce(commit_id, '')) = '' THEN 'missing commit_id' END, CASE WHEN trim(coalesce(theme, '')) = '' THEN 'missing theme' END, CASE WHEN trim(coalesce(summary, '')) = '' THEN 'missing summary' END,
   CASE WHEN coalesce(op, '') NOT IN ('feat','bugfix','refactor','optimize','cleanup','config','docs','test','compat','safety','other') THEN 'invalid op: ' || coalesce(op, 'null') END,
   CASE WHEN coalesce(importance, '') NOT IN ('primary','secondary') THEN 'invalid importance: ' || coalesce(importance, 'null') END,
   CASE WHEN coalesce(len(file_paths), 0) = 0 THEN 'no file_paths' END], lambda x: x IS NOT NULL) AS errors FROM change_units)
 SELECT unit_id, errors FROM e WHERE len(errors) > 0""",
    "stable_rule": """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
 o AS (SELECT CASE left(o_orderpriority, 1) WHEN '1' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS confidence, coalesce(n, 0) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
 SELECT confidence, count(*) AS n, sum(n)::BIGINT AS evidence FROM o WHERE n >= CASE WHEN confidence IN ('high', 'medium') THEN 2 ELSE 1 END GROUP BY confidence""",
    "recommend": """WITH o AS (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'F') AS s FROM orders GROUP BY 1),
 c AS (SELECT c_custkey, c_name, coalesce(n, 0) AS n, coalesce(s, 0) AS s, CASE WHEN c_acctbal > 6000 THEN 'high' WHEN c_acctbal > 0 THEN 'medium' ELSE 'low' END AS conf FROM customer LEFT JOIN o ON o_custkey = c_custkey),
 b AS (SELECT *, CASE conf WHEN 'high' THEN 8.0::DOUBLE WHEN 'medium' THEN 6.0 ELSE 3.0 END AS base FROM c),
 v AS (SELECT *, round(least(base + least(n * 0.5::DOUBLE, 2.0), 10.0), 1) AS business, round(least(base + least(s * 0.3::DOUBLE, 1.0), 10.0), 1) AS value,
   CASE WHEN coalesce(c_name, '') = '' THEN 'fail' WHEN conf = 'high' THEN 'pass' WHEN conf = 'medium' AND n > 0 THEN 'pass' ELSE 'fail' END AS validity FROM b)
 SELECT c_custkey, 'rec_customer_' || substr(sha256('customer:' || c_name), 1, 12) AS rec_id, business, value, validity,
   CASE WHEN validity = 'fail' THEN 'drop' WHEN greatest(business, value) >= 7 THEN 'keep' WHEN greatest(business, value) >= 5 THEN 'verify_first' ELSE 'backlog' END AS action FROM v""",
    "stable_ids": "SELECT p_partkey, 'part_' || substr(sha256('part:' || p_name), 1, 12) AS id, substr(sha256(coalesce(p_name, '')), 1, 16) AS digest FROM part",
    "development_types": f"""WITH k AS (SELECT doc_id, {_KINDS} AS k FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, coalesce(k[1], 'feature') AS development_type, list_sort(k) AS kinds, CASE WHEN len(k) > 1 THEN 'Multiple development intents detected (' || array_to_string(list_sort(k), ', ') || '); confirm primary type is ''' || k[1] || '''.'
   WHEN len(k) = 0 THEN 'Issue intent is unclear; confirm whether this is feature, bugfix, refactor, migration, or optimize.' END AS question FROM k""",
    "intents": """WITH t AS (SELECT lower(coalesce(text, '')) AS l FROM documents)
 SELECT CASE WHEN contains(l, 'status') OR contains(l, 'check') OR contains(l, 'where') OR contains(l, 'what is') THEN 'status' WHEN contains(l, 'reset') OR contains(l, 'clear') OR contains(l, 'start over') THEN 'reset'
   WHEN contains(l, 'step') OR contains(l, 'next') OR contains(l, 'continue one') THEN 'step' WHEN contains(l, 'resume') OR contains(l, 'continue') OR contains(l, 'proceed') OR contains(l, 'go on') THEN 'resume' ELSE 'run' END AS intent,
   count(*) AS n FROM t GROUP BY 1""",
    "token_counts": f"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS n_tokens, len({_TOK.format(c="text")}) AS n_signal,
   length(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS phrase_chars FROM documents WHERE text IS NOT NULL""",
    "file_filters": """SELECT raw_id, len(list_filter(files, lambda f: f IS NOT NULL AND NOT starts_with(f, 'docs/') AND NOT starts_with(f, 'build/'))) AS kept,
   len(list_filter(files, lambda f: contains(lower(f), 'test'))) AS tests FROM raw_commits WHERE files IS NOT NULL""",
    "distinct_files": r"""SELECT raw_id, list_sort(list_distinct(list_filter(files, lambda x: x IS NOT NULL AND x <> ''))) AS sorted_files,
   CASE WHEN files IS NOT NULL THEN list_filter(list_transform(range(1, len(files) + 1), lambda i: CASE WHEN trim(files[i]) <> '' AND list_position(list_transform(files, lambda y: trim(y)), trim(files[i])) = i THEN trim(files[i]) END), lambda x: x IS NOT NULL) END AS ordered_files,
   list_filter(['README.md', 'pkg', 'src'], lambda r: NOT list_contains(list_transform(coalesce(files, []), lambda f: string_split(f, '/')[1]), r)) AS missing FROM raw_commits""",
    "aliases_ci": r"""WITH k AS (SELECT domain_id, list_filter(list_transform(keywords, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS c FROM domains WHERE keywords IS NOT NULL)
 SELECT domain_id, list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN list_position(list_transform(c, lambda y: lower(y)), lower(c[i])) = i THEN c[i] END), lambda x: x IS NOT NULL) AS keywords FROM k""",
    "missing_headings": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_kind IN ('change_analysis', 'design_note', 'dossier_section'))
 SELECT doc_id, list_filter(['Risk of', 'Change', 'Missing'], lambda h: NOT regexp_matches(text, '(?im)^##\s+' || h || '([^\p{L}\p{N}_]|$)')) AS missing,
   regexp_matches(text, '(?im)^##\s+Risk([^\p{L}\p{N}_]|$)') OR regexp_matches(text, '(?im)^##\s+Change([^\p{L}\p{N}_]|$)') AS "any" FROM t""",
    "month_partition": "SELECT coalesce(strftime(ingested_at, '%Y-%m'), 'unknown') AS month, count(*) AS n, count(DISTINCT commit_id) AS commits FROM raw_commits GROUP BY 1",
    "diff_stats": r"""WITH c AS (SELECT unnest(diff_chunks) AS c FROM raw_commits), s AS (SELECT regexp_extract(c, '^diff --git a/\S+ b/(\S+)', 1) AS path, string_split(c, chr(10)) AS ls FROM c WHERE c IS NOT NULL)
 SELECT path, count(*) AS chunks, sum(len(list_filter(ls, lambda l: starts_with(l, '+') AND NOT starts_with(l, '+++ '))))::BIGINT AS added,
   sum(len(list_filter(ls, lambda l: starts_with(l, '-') AND NOT starts_with(l, '--- '))))::BIGINT AS removed FROM s GROUP BY path""",
    "context_aliases": """WITH r AS (SELECT record_id, CASE WHEN json_valid(payload) THEN json_extract(payload, '$.shared_hints.aliases') END AS a FROM context_records),
 e AS (SELECT record_id, unnest(from_json(a, '["JSON"]')) AS x FROM r WHERE json_type(a) = 'ARRAY'),
 v AS (SELECT record_id, trim(coalesce(nullif(x->>'canonical', ''), nullif(x->>'domain', ''), '')) AS canonical, trim(coalesce(nullif(x->>'alias', ''), nullif(x->>'name', ''), '')) AS alias, coalesce(nullif(trim(coalesce(x->>'kind', 'term')), ''), 'term') AS kind FROM e)
 SELECT record_id, canonical, alias, kind FROM v WHERE canonical <> '' AND alias <> ''""",
}
