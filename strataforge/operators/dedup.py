"""Distinct values and rows, merging of overlapping records. Winners are aggregates, not first rows of sorted windows,
so a key that holds a third of all rows is pre-aggregated before it moves."""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions import text as T

#: Rows of one key up to which records are merged greedily: an order-dependent fold runs in one task.
MAX_FOLD = 200_000


def sorted_distinct(arr: Column) -> Column:
    """Sorted distinct non-empty strings; null gives null."""
    return F.array_sort(F.array_distinct(F.filter(arr, lambda x: x.isNotNull() & (x != ""))))


def ordered_distinct(arr: Column) -> Column:
    """Trimmed distinct strings in order of first occurrence, null and blank ones dropped."""
    return F.array_distinct(F.filter(F.transform(arr, T.squeeze), lambda x: x.isNotNull() & (x != "")))


def ordered_distinct_ci(arr: Column) -> Column:
    """As ``ordered_distinct`` ignoring case: the first spelling stays."""
    clean = F.filter(F.transform(arr, T.squeeze), lambda x: x.isNotNull() & (x != ""))
    low = F.transform(clean, F.lower)
    return F.transform(F.array_distinct(low), lambda x: F.element_at(clean, F.array_position(low, x).cast("int")))


def filled_or(arr: Column, other: str) -> Column:
    """The non-null elements of an array; one stand-in where there are none."""
    some = F.filter(arr, lambda x: x.isNotNull())
    return F.when(F.coalesce(F.size(some), F.lit(0)) > 0, some).otherwise(F.array(F.lit(other)))


def intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def missing(required: list[str], present: Column) -> Column:
    """Required names that aren't present, in their order."""
    return F.array_except(F.lit(required), present)


def overlap_smaller(a: Column, b: Column) -> Column:
    """|A and B| / min(|A|, |B|); 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def overlap_larger(a: Column, b: Column) -> Column:
    """|A and B| / max(|A|, |B|); 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.greatest(F.size(a), F.size(b))), F.lit(0.0))


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """rows with ``kept``: the first of each key by ``order`` (unique), the others are its duplicates. Null keys are one key."""
    heads = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).agg(F.min(order).alias("_first"))
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(heads, on).select(*rows.columns, (F.col(order) == F.col("_first")).alias("kept"))


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; rows with a null key are dropped."""
    present = rows
    for k in key:
        present = present.filter(F.col(k).isNotNull())
    rest = [c for c in rows.columns if c not in key]
    return present.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_w")).select(*key, "_w.*")


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of all sources; a column that a source lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# Names that say nothing.
NOISE = ("misc", "other", "others", "general", "generic", "unknown", "uncategorized")


def named(name: Column) -> Column:
    """Neither blank nor one of the noise names, ignoring case and blanks around."""
    n = F.lower(T.squeeze(F.coalesce(name, F.lit(""))))
    return (n != "") & ~n.isin(*NOISE)


def _other_number(name: str) -> str:
    """The plural of a singular name, the singular of a plural one."""
    return name[:-1] if len(name) > 1 and name[-1] == "s" else name + "s"


def fold_records(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy clustering in row order: a record merges into the first cluster it is like, else begins one.

    Like: equal names or singular and plural; two or more shared keywords that are half of the smaller set; shared paths that
    are 0.6 of the smaller set. What a record shares with each cluster is counted through inverted lists. A cluster keeps its
    place and is never compared with others again. Its name is the plural of the two, else that of the side with more paths,
    then keywords, then description; the older on a tie.
    """
    if len(pdf) > MAX_FOLD:
        raise ValueError(f"{len(pdf)} records of one key; a greedy fold is meant for up to {MAX_FOLD}")
    names: list[str] = []  # of each cluster, as compared
    words: list[set[str]] = []
    made: list[dict] = []
    of_name, of_word, of_path = defaultdict(set), defaultdict(set), defaultdict(set)
    for name, description, paths, keywords in pdf.sort_values("ord", kind="stable")[["name", "description", "paths", "keywords"]].itertuples(index=False):
        paths = {p for p in (() if paths is None else paths) if p}
        keywords = {k for k in (() if keywords is None else keywords) if k}
        key, low = name.strip().lower(), {k.strip().lower() for k in keywords} - {""}
        common_words, common_paths = Counter(i for w in low for i in of_word[w]), Counter(i for p in paths for i in of_path[p])
        fits = [i for i in of_name[key] | of_name[_other_number(key)] if names[i] in (key, _other_number(key))]
        fits += [i for i, n in common_words.items() if n >= 2 and 2 * n >= min(len(low), len(words[i]))]
        fits += [i for i, n in common_paths.items() if 5 * n >= 3 * min(len(paths), len(made[i]["paths"]))]
        at = min(fits, default=len(made))
        new = {"name": name, "description": description or "", "paths": paths, "keywords": keywords, "members": 1}
        if at == len(made):
            names.append(key)
            words.append(low)
            made.append(new)
        else:
            old = made[at]
            pair = names[at] != key and names[at] == _other_number(key)
            rank = lambda r, n: (pair and n[-1:] == "s", len(r["paths"]), len(r["keywords"]), len(r["description"].strip()))
            first, second = (new, old) if rank(new, key) > rank(old, names[at]) else (old, new)
            names[at] = key if first is new else names[at]
            words[at] = words[at] | low
            made[at] = {
                "name": first["name"], "description": first["description"] or second["description"], "paths": old["paths"] | paths, "keywords": old["keywords"] | keywords, "members": old["members"] + 1,
            }
        of_name[names[at]].add(at)
        for w in low:
            of_word[w].add(at)
        for x in paths:
            of_path[x].add(at)
    head = pdf["key"].iloc[0]
    return pd.DataFrame([{"key": head, "no": i, **c, "paths": sorted(c["paths"]), "keywords": sorted(c["keywords"])} for i, c in enumerate(made)], columns=["key", "no", "name", "description", "paths", "keywords", "members"])


def merge_records(records: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(key, no, name, description, paths, keywords, members): greedy, order-dependent merging within each key.

    This is *not* connected components: a record joins the first cluster it is like and clusters are never joined later.
    Noise names and blank names are left out. The fold of a key runs in one task, so keys must be dimensions (MAX_FOLD is
    enforced); ``fuzzy_pairs`` gives the underlying relation at any size.
    """
    rows = records.filter(named(F.col(name)) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(order).alias("ord"), F.col(name).alias("name"), "description", "paths", "keywords")
    out = rows.groupBy("key").applyInPandas(fold_records, "key bigint, no bigint, name string, description string, paths array<string>, keywords array<string>, members bigint")
    return out.withColumnRenamed("key", key)


def unique_sections(sections: DataFrame, doc: str, title: str) -> DataFrame:
    """Sections whose title occurs once in their document; titles that repeat are dropped altogether."""
    n = sections.groupBy(doc, title).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return sections.join(n, [doc, title], "left_semi")


def canonical_case(cases: DataFrame, key: list[str], value: str, text: str, case_id: str) -> DataFrame:
    """Per key the case of the highest value, the text nearest to 18 characters, the smallest id; with its group size."""
    rank = F.when(F.col(value) == "high", 0).when(F.col(value) == "medium", 1).when(F.col(value) == "low", 2).otherwise(3)
    best = F.min(F.struct(rank.alias("r"), F.abs(F.length(text) - 18).alias("d"), F.col(case_id).alias("id")))
    return cases.groupBy(*key).agg(best["id"].alias(case_id), F.count("*").alias("cases"))


def similarity(a: Column, b: Column, text_a: Column, text_b: Column, limits_a: Column, limits_b: Column) -> Column:
    """0.5 sequence ratio + 0.3 Jaccard of tokens + 0.2 Jaccard of limits, for candidate pairs already found."""
    import difflib

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "", autojunk=False).ratio() for p, q in zip(x, y)], dtype="float64")

    jac = lambda p, q: F.coalesce(F.try_divide(F.size(F.array_intersect(p, q)), F.size(F.array_union(p, q))), F.lit(0.0))
    return 0.5 * ratio(text_a, text_b) + 0.3 * jac(a, b) + 0.2 * jac(limits_a, limits_b)
