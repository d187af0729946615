"""The queries of the training-data operators and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm import bpe, canon, leakage, pieces, setjoin, spans, subjects, survivors
from strataforge.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    sets = setjoin.domain_sets(table(spark, d, "domains"))
    return setjoin.similar_pairs(sets).withColumnRenamed("field", "on_field")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    sets = setjoin.domain_sets(table(spark, d, "domains"))
    return setjoin.linked_records(sets).select(F.col("field").alias("on_field"), F.col("id").alias("domain_id"), "class_id", "n_links")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.found(table(spark, d, "raw_commits"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(pieces.items(table(spark, d, "raw_commits")), ["raw_id", "item_kind", "item_no"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    shared = spans.shared_chars(spans.commit_texts(table(spark, d, "raw_commits")))
    return shared.select(F.col("row_id").alias("raw_id"), "shared_chars")


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    found = spans.shared_spans(spans.commit_texts(table(spark, d, "raw_commits")))
    return found.select(F.col("row_id").alias("raw_id"), F.col("no").alias("chunk_no"), "start", "stop", F.col("ref_row").alias("ref_raw_id"), F.col("ref_no").alias("ref_chunk_no"), "ref_start")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.alias_terms(table(spark, d, "alias_entries"), table(spark, d, "canonical_terms"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "domains"), table(spark, d, "trust_sources"))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return survivors.surviving_records(table(spark, d, "domains"), table(spark, d, "trust_sources"))


def p7_currency(spark: SparkSession, d: str) -> DataFrame:
    return survivors.most_current(table(spark, d, "domains"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages with up to two words changed, dropped or added; the README has the measured recall."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id", edits=2, samples=6, repeats=16, slack=2)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return subjects.classify(docs, subjects.train(docs, table(spark, d, "doc_labels"), table(spark, d, "subjects")))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_classes, p3_found, p3_pieces, p5_found, p5_spans, p6_found, p7_found, p7_records, p7_currency, p8_ids, p9_found, p9_near, p10_found)
}

_SETS = r"""
 elements AS (
   SELECT 'keywords' AS f, domain_id AS id, lower(regexp_replace(u, '^\s+|\s+$', '', 'g')) AS tok
   FROM (SELECT domain_id, unnest(keywords) AS u FROM domains)
   UNION
   SELECT 'paths', domain_id, regexp_replace(regexp_replace(replace(regexp_replace(u, '^\s+|\s+$', '', 'g'), '\', '/'), '^\./', ''), '/+$', '')
   FROM (SELECT domain_id, unnest(paths) AS u FROM domains)),
 toks AS (SELECT DISTINCT f, id, tok FROM elements WHERE tok <> ''),
 sizes AS (SELECT f, id, count(*) AS n, md5(string_agg(tok, chr(31) ORDER BY tok)) AS body FROM toks GROUP BY f, id),
 shared AS (
   SELECT a.f, a.id AS l, b.id AS r, count(*) AS k FROM toks a JOIN toks b ON a.f = b.f AND a.tok = b.tok AND a.id < b.id GROUP BY a.f, a.id, b.id),
 pairs AS (
   SELECT s.f, s.l, s.r FROM shared s JOIN sizes x ON x.f = s.f AND x.id = s.l JOIN sizes y ON y.f = s.f AND y.id = s.r
   WHERE s.k * 8 >= 3 * (x.n + y.n))
"""

_SURVIVORS = r"""
 d AS (
   SELECT *, regexp_replace(regexp_replace(lower(domain_name), '[\s_-]+', '', 'g'), 's$', '') AS key,
     coalesce((SELECT min(trust_rank) FROM trust_sources t WHERE t.source = domains.source), 1000000) AS trust,
     len(list_filter(list_distinct(list_transform(coalesce(paths, []), lambda u:
       regexp_replace(regexp_replace(replace(regexp_replace(u, '^\s+|\s+$', '', 'g'), '\', '/'), '^\./', ''), '/+$', ''))), lambda u: u <> '')) AS n_paths,
     len(list_filter(coalesce(keywords, []), lambda u: trim(u) <> '')) AS n_words,
     len(list_filter(coalesce(paths, []), lambda u: trim(u) <> '')) AS n_entries
   FROM domains WHERE trim(domain_name) <> '' AND repo_id IS NOT NULL),
 g AS (SELECT repo_id, key, min(domain_id) AS group_id FROM d GROUP BY repo_id, key HAVING count(*) >= 2),
 m AS (SELECT d.*, group_id FROM d JOIN g USING (repo_id, key)),
 s AS (
   SELECT group_id, 'description' AS field_name, domain_id AS from_id, row_number() OVER (PARTITION BY group_id ORDER BY trust, seen_at DESC NULLS LAST, domain_id) AS rn
   FROM m WHERE trim(description) <> ''
   UNION ALL
   SELECT group_id, 'keywords', domain_id, row_number() OVER (PARTITION BY group_id ORDER BY seen_at DESC NULLS LAST, trust, domain_id) FROM m WHERE n_words > 0
   UNION ALL
   SELECT group_id, 'paths', domain_id, row_number() OVER (PARTITION BY group_id ORDER BY n_paths DESC, trust, seen_at DESC NULLS LAST, domain_id) FROM m WHERE n_entries > 0)
"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_SETS} SELECT f AS on_field, l AS id_a, r AS id_b FROM pairs",
    "p1_classes": f"""WITH {_SETS},
 both_ways AS (SELECT f, l AS id FROM pairs UNION ALL SELECT f, r FROM pairs),
 links AS (SELECT f, id, count(*) AS n FROM both_ways GROUP BY f, id)
 SELECT s.f AS on_field, s.id AS domain_id, min(s.id) OVER (PARTITION BY s.f, s.body) AS class_id, coalesce(links.n, 0) AS n_links
 FROM sizes s LEFT JOIN links USING (f, id)""",
    "p3_found": r"""WITH chunks AS (
   SELECT raw_id, 'diff_chunks' AS item_kind, CAST(i - 1 AS INTEGER) AS item_no, diff_chunks[i] AS t
   FROM (SELECT raw_id, diff_chunks, unnest(range(1, len(diff_chunks) + 1)) AS i FROM raw_commits)),
 lists AS (SELECT raw_id, 'files' AS item_kind, CAST(0 AS INTEGER) AS item_no, array_to_string(files, chr(10)) AS t FROM raw_commits),
 items AS (SELECT * FROM chunks UNION ALL SELECT * FROM lists),
 big AS (SELECT * FROM items WHERE strlen(t) > 4000)
 SELECT raw_id, item_kind, item_no, 'oversized' AS case_kind FROM big
 UNION ALL
 SELECT raw_id, item_kind, item_no, 'long_line' FROM big WHERE item_kind = 'diff_chunks'
   AND len(list_filter(string_split(t, chr(10)), lambda x: strlen(regexp_replace(x, '\r$', '')) > 4000)) > 0""",
    "p7_found": f"WITH {_SURVIVORS} SELECT group_id, field_name, from_id FROM s WHERE rn = 1",
    "p7_records": f"""WITH {_SURVIVORS}, w AS (SELECT * FROM s WHERE rn = 1)
 SELECT DISTINCT h.domain_id AS group_id, h.repo_id, h.domain_name, a.description, b.keywords, c.paths
 FROM (SELECT DISTINCT group_id FROM w) x JOIN domains h ON h.domain_id = x.group_id
 LEFT JOIN w wa ON wa.group_id = x.group_id AND wa.field_name = 'description' LEFT JOIN domains a ON a.domain_id = wa.from_id
 LEFT JOIN w wb ON wb.group_id = x.group_id AND wb.field_name = 'keywords' LEFT JOIN domains b ON b.domain_id = wb.from_id
 LEFT JOIN w wc ON wc.group_id = x.group_id AND wc.field_name = 'paths' LEFT JOIN domains c ON c.domain_id = wc.from_id""",
}
