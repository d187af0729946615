"""Aggregations. Every one is a groupBy with map-side combine; collected lists are cut to a stated size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_modules(commits: DataFrame, order: str, files: str, most: int = 10, least: int = 2) -> DataFrame:
    """(module, touches, files, rank): the ``most`` first path components by file touches, then those of ``least`` or more.

    A file named twice counts twice; a path without a slash is in ``root``. Ties go to the module seen first (by ``order``
    and position).
    """
    f = commits.select(F.col(order).alias("_o"), F.posexplode(files).alias("_i", "_p")).filter(F.col("_p").isNotNull())
    module = F.when(F.contains("_p", F.lit("/")), F.substring_index("_p", "/", 1)).otherwise("root")
    g = f.groupBy(module.alias("module")).agg(F.count("*").alias("touches"), F.count_distinct("_p").alias("files"), F.min(F.struct("_o", "_i")).alias("_seen"))
    top = g.orderBy(F.desc("touches"), "_seen").limit(most)
    # at most ``most`` rows are left, so numbering them in one place is free
    from pyspark.sql import Window as W

    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("touches"), "_seen")).cast("bigint")).filter(F.col("touches") >= least).drop("_seen")


def distribution(rows: DataFrame, value: Column, order: str, most: int = 30) -> DataFrame:
    """(value, n): the ``most`` commonest values, ties by first occurrence."""
    g = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("_seen"))
    return g.orderBy(F.desc("n"), "_seen").limit(most).drop("_seen")


def representatives(rows: DataFrame, group: Column, text: str, order: str, most: int = 5) -> DataFrame:
    """(grp, text): the first non-empty text of each group, for the ``most`` groups that have one first."""
    g = rows.filter(F.coalesce(F.col(text), F.lit("")) != "").groupBy(group.alias("grp")).agg(F.min(F.struct(order, text)).alias("_f"))
    return g.orderBy(F.col("_f")[order]).limit(most).select("grp", F.col("_f")[text].alias(text))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; 0 where there is no whole."""
    return F.coalesce(F.round(F.try_divide(part, whole), digits), F.lit(0.0))


def health(rows: DataFrame, mixed: Column, low: Column, stable: Column, covered: Column, drifted: Column) -> DataFrame:
    """One row of quality metrics over all rows; of no rows all are 0."""
    return rows.agg(
        F.count("*").alias("candidates"),
        F.count_if(stable).alias("stable"),
        ratio(F.count_if(mixed), F.count("*")).alias("mixed_ratio"),
        ratio(F.count_if(low), F.count("*")).alias("low_signal_ratio"),
        ratio(F.count_if(stable & covered), F.count_if(stable)).alias("evidence_coverage"),
        F.count_if(drifted).alias("naming_drift"),
    )


def feedback(rows: DataFrame, level: str, outcome: str) -> DataFrame:
    """(level, accepted, rejected, other, total, rate): outcomes by level, rate in percent of all."""
    acc, rej = F.col(outcome) == "accepted", F.col(outcome) == "rejected"
    return rows.groupBy(level).agg(
        F.count_if(acc).alias("accepted"), F.count_if(rej).alias("rejected"), F.count_if(~F.coalesce(acc | rej, F.lit(False))).alias("other"), F.count("*").alias("total"),
        F.round(100 * ratio(F.count_if(acc), F.count("*"), 6), 1).alias("rate"),
    )


def conflicts(rows: DataFrame, key: list[str], source: str, row_id: str) -> DataFrame:
    """Keys with two or more rows of more than one source: (key, rows, sources, first_id)."""
    g = rows.groupBy(*key).agg(F.count("*").alias("n_rows"), F.count_distinct(F.coalesce(source, F.lit(""))).alias("n_sources"), F.min(row_id).alias("first_id"))
    return g.filter("n_rows >= 2 and n_sources > 1")


def adjudicated(found: Column, claim: Column) -> Column:
    """Status of a claim by the number of places it was found in."""
    must = F.lower(claim).rlike("must|shall")
    return F.when(found >= 2, "evidence_backed").when(found == 1, "weakly_backed").when(must, "drift").otherwise("gap")


def signals(rows: DataFrame, category: str) -> DataFrame:
    """(category, n, summary): one signal per non-empty category."""
    g = rows.groupBy(category).agg(F.count("*").alias("n"))
    return g.select(category, "n", F.format_string("%s: %d entries", F.coalesce(category, F.lit("none")), "n").alias("summary"))


def size_summary(entries: DataFrame, size: str, hit: str) -> DataFrame:
    """One row: entries, bytes, hit rate in percent."""
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), (100 * ratio(F.count_if(F.col(hit)), F.count("*"), 6)).alias("hit_rate"))


def merged_signals(documents: DataFrame, doc_order: str, index: str, category: str, value: str) -> DataFrame:
    """(category, doc_order, index, value): the values of all documents, per category in document order.

    Rows in order, not lists: a category of any size is sorted by range and collected nowhere.
    """
    return documents.select(category, doc_order, index, value).orderBy(category, doc_order, index)


def change_log(decisions: DataFrame, action: str, name: str, kind: str, reason: str, target: str) -> DataFrame:
    """(bucket, name, kind, reason, target) of decisions: added, merged (alone with a target), dropped or deferred; others are left out."""
    a = F.col(action)
    bucket = F.when(a == "keep", "added").when(a == "merge", "merged").when(a == "drop", "dropped").when(a.isin("backlog", "verify_first"), "deferred")
    return decisions.select(bucket.alias("bucket"), F.col(name).alias("name"), F.col(kind).alias("kind"), F.col(reason).alias("reason"), F.when(a == "merge", F.col(target)).alias("target")).filter("bucket is not null")


def versions(files: DataFrame, path: str) -> DataFrame:
    """(artifact, versions) of names like x.v3.md, in numeric order."""
    name, v = F.regexp_extract(path, r"^(.*)\.v(\d+)\.[^.]+$", 1), F.regexp_extract(path, r"^(.*)\.v(\d+)\.[^.]+$", 2)
    f = files.select(name.alias("artifact"), v.try_cast("int").alias("v")).filter("v is not null")
    return f.groupBy("artifact").agg(F.array_sort(F.collect_set("v")).alias("versions"))


def theme_patterns(units: DataFrame, theme: Column, commit: str, op: Column, importance: Column) -> DataFrame:
    """(theme, n, distinct_commits, primary_ratio, frequent): themes of units; frequent in three or more commits."""
    g = units.groupBy(theme.alias("theme")).agg(F.count("*").alias("n"), F.count_distinct(commit).alias("distinct_commits"), ratio(F.count_if(importance == "primary"), F.count("*")).alias("primary_ratio"))
    return g.withColumn("frequent", F.col("distinct_commits") >= 3)


def op_distribution(units: DataFrame, theme: Column, op: Column) -> DataFrame:
    """(theme, ops): how often each op occurs per theme, as a map."""
    g = units.groupBy(theme.alias("theme"), op.alias("op")).agg(F.count("*").alias("n"))
    return g.groupBy("theme").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("op", "n")))).alias("ops"))


def demand_scores(units: DataFrame, theme: Column, commit: str, importance: Column, most: int = 50) -> DataFrame:
    """(theme, distinct_commits, score): distinct commits times the mean weight (primary 2, else 1); the ``most`` best."""
    w = F.avg(F.when(importance == "primary", 2.0).otherwise(1.0))
    g = units.groupBy(theme.alias("theme")).agg(F.count_distinct(commit).alias("distinct_commits"), F.round(F.count_distinct(commit) * w, 4).alias("score"))
    return g.orderBy(F.desc("score"), F.desc("distinct_commits"), "theme").limit(most)


def unit_summary(units: DataFrame, theme: Column, op: Column, at: Column, ops: tuple[str, ...]) -> DataFrame:
    """One row: units, themes, share of bug fixes, how many units each op has (``ops``: its known values), first and last time."""
    n = [F.struct(F.lit(o).alias("op"), F.count_if(op == o).alias("n")) for o in ops]
    return units.agg(
        F.count("*").alias("total_units"), F.count_distinct(theme).alias("total_patterns"), ratio(F.count_if(op == "bugfix"), F.count("*")).alias("bugfix_ratio"),
        F.array(*n).alias("ops"), F.min(at).alias("first_at"), F.max(at).alias("last_at"),
    )


def export_statistics(cases: DataFrame, passed: Column, bugfix: Column, split: Column) -> DataFrame:
    """One row: cases, and the shares that pass, are bug fixes, are to be split."""
    return cases.agg(F.count("*").alias("cases"), ratio(F.count_if(passed), F.count("*")).alias("pass_rate"), ratio(F.count_if(bugfix), F.count("*")).alias("bugfix_ratio"), ratio(F.count_if(split), F.count("*")).alias("split_ratio"))


def hint_counts(hints: dict[str, Column], sources: dict[str, Column]) -> tuple[Column, Column]:
    """(all hints, struct of entries per source) of arrays; null arrays count 0."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    total = F.lit(0)
    for c in hints.values():
        total = total + n(c)
    return total, F.struct(*(n(c).alias(k) for k, c in sources.items()))


def adjudicated_facts(claims: DataFrame, facts: DataFrame, status: str) -> DataFrame:
    """Facts with the claims that were found in the code, strongly or weakly; columns that a side lacks are null."""
    return facts.unionByName(claims.filter(F.col(status).isin("evidence_backed", "weakly_backed")), allowMissingColumns=True)


def nested_units(commits: DataFrame, sections: str, flags: list[str]) -> DataFrame:
    """Commits with ``sections`` (array of structs with an array ``items`` of op and summary) as a row per item.

    The flags of the commit go with each row. A section without items is one row without op, a commit without sections one
    row without a section.
    """
    s = commits.select(*flags, F.explode_outer(sections).alias("s"))
    i = s.select(*flags, "s", F.explode_outer("s.items").alias("i"))
    return i.select(*flags, F.col("s.name").alias("section_name"), "s.theme", "s.importance", "i.op", F.coalesce("i.summary", "s.summary").alias("summary"))


def banded(n: Column) -> Column:
    """Band of a number of patterns: none, sparse (under 3), usual (under 10), dense."""
    return F.when(n == 0, "none").when(n < 3, "sparse").when(n < 10, "usual").otherwise("dense")
