"""Joins with rules of their own: longest prefix, scored argmax, fuzzy pairs, phrases, snapshots, presence.

All candidate pairs come from equi-joins on something shared (a token, a prefix), never from pairing all rows; small
literal lists are scored inside a projection instead of being joined. Scored winners are read off bit sets, without pairs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataforge.functions import text as T

#: So many lengths of the dimension's prefixes are sent to the tasks; beyond, a path is cut at every length.
MAX_LENGTHS = 4096


def _clean(arr: str) -> Column:
    return F.filter(F.coalesce(F.col(arr), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def _cuts(lengths: DataFrame, path: Column) -> Column:
    """The lengths at which a path is to be cut: those that prefixes have, all where there are too many to send along."""
    known = sorted(r.n for r in lengths.distinct().limit(MAX_LENGTHS + 1).collect())
    if len(known) > MAX_LENGTHS:
        return F.when(F.length(path) > 0, F.sequence(F.lit(1), F.length(path)))
    return F.filter(F.lit(known).cast("array<int>") if known else F.array().cast("array<int>"), lambda n: n <= F.length(path))


def prefix_winner(facts: DataFrame, dims: DataFrame, key: list[str], fact_id: str, paths: str, dim: str, prefixes: str, order: str) -> DataFrame:
    """Longest-prefix join, one winner per fact: (fact_id, dim) or a null dim.

    Each path takes the dim with the longest matching prefix (of equally long ones the first by ``order``); a fact has a dim
    if all its matched paths agree, unmatched paths don't count. Instead of comparing every path with every prefix, a path is
    cut at the lengths that prefixes have and joined by equality, within equal ``key`` columns.
    """
    d = dims.select(*key, F.col(dim).alias("_dim"), F.col(order).alias("_ord"), F.explode(_clean(prefixes)).alias("_pre"))
    d = d.groupBy(*key, "_pre").agg(F.min(F.struct("_ord", "_dim"))["_dim"].alias("_dim"))
    f = facts.select(*key, F.col(fact_id).alias("_id"), F.explode(F.array_distinct(_clean(paths))).alias("_path"))
    f = f.select("*", F.explode(_cuts(d.select(F.length("_pre").alias("n")), F.col("_path"))).alias("_n")).withColumn("_pre", F.substring("_path", F.lit(1), F.col("_n")))
    per_path = f.join(d, [*key, "_pre"]).groupBy("_id", "_path").agg(F.max_by("_dim", "_n").alias("_dim"))
    won = per_path.groupBy("_id").agg(F.min("_dim").alias("_lo"), F.max("_dim").alias("_hi"))
    return facts.select(F.col(fact_id).alias("_id")).join(won, "_id", "left").select(F.col("_id").alias(fact_id), F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(dim))


# Weights of the evidence, the least score and the least lead over the second.
PATH, THEME, SUMMARY, SECTION, KEYWORD, LEAST, LEAD = 5, 3, 2, 2, 1, 4, 2


#: Most units and dims of a key that meet in one task (beyond, a key is cut into blocks), and most bit sets a task keeps of each kind.
UNIT_BLOCK, DIM_BLOCK, SETS = 1 << 16, 1 << 15, 1 << 13

_POINTS = (THEME, SUMMARY, SECTION, KEYWORD, PATH)
_SCORE = [sum(p for i, p in enumerate(_POINTS) if m >> i & 1) for m in range(32)]
#: For each set of kinds of evidence: the scores that its subsets have, the highest first, with these subsets.
_LEVELS = [[(s, [m for m in range(1, 32) if m & have == m and _SCORE[m] == s]) for s in sorted({_SCORE[m] for m in range(1, 32) if m & have == m}, reverse=True)] for have in range(32)]


class _Postings:
    """Which dims of a block hold a token or a prefix, as the bits of an int in the order of the dims' names."""

    def __init__(self, size: int, of: dict[int, set[str]]):
        self.size, self.ids, self.sets = size, {}, {}
        for i, items in of.items():
            for x in items:
                self.ids.setdefault(x, []).append(i)

    def any_of(self, items) -> int:
        out = 0
        for x in items:
            got = self.sets.get(x)
            if got is None:
                ids = self.ids.get(x)
                if ids is None:
                    continue
                flags = bytearray(self.size // 8 + 1)
                for i in ids:
                    flags[i >> 3] |= 1 << (i & 7)
                got = int.from_bytes(flags, "little")
                if len(ids) > 4 and len(self.sets) < SETS:
                    self.sets[x] = got
            out |= got
        return out


def _best_two(units: pa.Table, dims: pa.Table) -> pa.Table:
    """(_id, _dim, s): the best two dims of each unit that have any evidence; equal scores are ordered by name.

    The dims that a unit has one kind of evidence of are a union of postings; those with a score are what such unions share,
    taken from the highest score down. No pairs of units and dims are made.
    """
    names = sorted(set(dims["_dim"].to_pylist()), key=lambda n: (n is not None, n or ""))
    at = {n: i for i, n in enumerate(names)}
    tokens, keywords, prefixes = {}, {}, {}  # a dim may have several rows
    for n, of_name, of_kw, of_pre in zip(*(dims[c].to_pylist() for c in ("_dim", "_name", "_kw", "_pre"))):
        kw = of_kw.split()
        tokens.setdefault(at[n], set()).update(of_name.split(), kw)
        keywords.setdefault(at[n], set()).update(kw)
        prefixes.setdefault(at[n], set()).update(of_pre)
    sig, kws, pre = (_Postings(len(names), of) for of in (tokens, keywords, prefixes))
    lengths = sorted({len(p) for p in pre.ids})
    rows, won, scores = [], [], []
    for row, (theme, summary, section, paths) in enumerate(zip(*(units[c].to_pylist() for c in ("_theme", "_summary", "_section", "_paths")))):
        fields = theme.split(), summary.split(), section.split()
        cuts = {f[:n] for f in paths for n in lengths if n <= len(f)}
        bits = [*map(sig.any_of, fields), kws.any_of({t for f in fields for t in f}), pre.any_of(cuts)]
        share, taken = {0: -1}, 0  # share: dims with all evidence of a set
        for m in range(1, 32):
            rest = m & (m - 1)
            share[m] = share[rest] and share[rest] & bits[(m ^ rest).bit_length() - 1]
        left = 2
        for score, subsets in _LEVELS[sum(1 << i for i, b in enumerate(bits) if b)]:
            found = 0
            for m in subsets:
                found |= share[m]
            found &= ~taken
            while found and left:
                low = found & -found
                rows.append(row)
                won.append(names[low.bit_length() - 1])
                scores.append(score)
                found ^= low
                taken |= low
                left -= 1
            if not left:
                break
    return pa.table({"_id": units["_id"].take(pa.array(rows, pa.int64())), "_dim": pa.array(won, pa.string()), "s": pa.array(scores, pa.int32())})


def _blocks(units: DataFrame, dims: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Units and dims with _ub and _db so that each unit meets each dim of its key in one block, and no block is large."""
    n_units = units.groupBy(*key).agg(F.ceil(F.count("*") / UNIT_BLOCK).cast("int").alias("_nu"))
    n_dims = dims.groupBy(*key).agg(F.ceil(F.count("*") / DIM_BLOCK).cast("int").alias("_nd"))
    size = n_units.join(n_dims, key)
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    u = units.join(size, key).select("*", F.pmod(F.xxhash64("_id"), F.col("_nu")).cast("int").alias("_ub"), to("_nd").alias("_db"))
    d = dims.join(size, key).select("*", F.pmod(F.xxhash64("_dim"), F.col("_nd")).cast("int").alias("_db"), to("_nu").alias("_ub"))
    return u.drop("_nu", "_nd"), d.drop("_nu", "_nd")


def scored_winner(units: DataFrame, dims: DataFrame, key: list[str], unit_id: str, dim: str) -> DataFrame:
    """Best dim per unit with an ambiguity gate: (unit_id, dim, score, second).

    Evidence counts once each: a path under one of the dim's prefixes 5, a token of name or keywords in the theme 3, in the
    summary 2, in the section name 2, a keyword token in any of the three 1. The dim is null unless the best score is 4 or
    more and leads by 2 or more; equal scores are ordered by name. Units without any evidence have score 0.
    """
    tok = lambda c: F.array_join(T.signal_tokens(F.coalesce(F.col(c), F.lit(""))), " ")
    u = units.select(*key, F.col(unit_id).alias("_id"), tok("theme").alias("_theme"), tok("summary").alias("_summary"), tok("section_name").alias("_section"), F.array_distinct(_clean("file_paths")).alias("_paths"))
    kw = F.array_join(F.array_distinct(F.flatten(F.transform(_clean("keywords"), T.signal_tokens))), " ")
    d = dims.select(*key, F.col(dim).alias("_dim"), tok(dim).alias("_name"), kw.alias("_kw"), F.array_distinct(_clean("paths")).alias("_pre"))
    u, d = _blocks(u, d, key)
    kind = dict(u.dtypes)["_id"]
    at = [*key, "_ub", "_db"]
    scored = u.groupBy(*at).cogroup(d.groupBy(*at)).applyInArrow(_best_two, f"_id {kind}, _dim string, s int")
    # the best two per unit by aggregation, without sorting a unit's candidates in a window
    first = scored.groupBy("_id").agg(F.min(F.struct((-F.col("s")).alias("n"), "_dim")).alias("b"), F.max("s").alias("top"), F.collect_list("s").alias("all"))
    second = F.coalesce(F.get(F.sort_array("all", asc=False), F.lit(1)), F.lit(0))
    best = first.select("_id", F.col("b._dim").alias("_dim"), F.col("top").alias("score"), second.alias("second"))
    out = units.select(F.col(unit_id).alias("_id")).join(best, "_id", "left")
    score, sec = F.coalesce("score", F.lit(0)), F.coalesce("second", F.lit(0))
    return out.select(F.col("_id").alias(unit_id), F.when((score >= LEAST) & (score - sec >= LEAD), F.col("_dim")).alias(dim), score.alias("score"), sec.alias("second"))


def _merge_rows(dims: DataFrame, key: list[str], dim_id: str, name: str, keywords: str, paths: str) -> DataFrame:
    """(key, _id, _name, _kw, _pa) of the named records: what ``fuzzy_pairs`` compares."""
    lower = lambda c: F.lower(F.trim(c))
    kw = F.array_sort(F.array_distinct(F.filter(F.transform(_clean(keywords), lower), lambda x: x != "")))
    pa = F.array_sort(F.array_distinct(_clean(paths)))
    return dims.select(*key, F.col(dim_id).alias("_id"), F.coalesce(lower(F.col(name)), F.lit("")).alias("_name"), kw.alias("_kw"), pa.alias("_pa")).filter("_name <> ''")


def fuzzy_pairs(dims: DataFrame, key: list[str], dim_id: str, name: str, keywords: str, paths: str) -> DataFrame:
    """(left_id, right_id), left_id < right_id, of records that may be merged.

    Within equal ``key``: equal names (trimmed, lower case), singular and plural of a name, two or more shared keywords
    that are at least half of the smaller set, or shared paths that are at least 0.6 of the smaller set. Of records alike in
    name, keywords and paths only the smallest id takes part (``record_classes`` has the others). Sets are probed by the
    rarest elements of the smaller one, as many as a qualifying pair can't all miss.
    """
    reps = _merge_rows(dims, key, dim_id, name, keywords, paths).groupBy(*key, "_name", "_kw", "_pa").agg(F.min("_id").alias("_id"))
    order = lambda a, b: (F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id"))
    # names: every name as itself, and a name without its final s as the plural of another
    n = reps.select(*key, F.col("_id").alias("a"), F.col("_name").alias("m"))
    p = reps.select(*key, F.col("_id").alias("b"), F.explode(F.array_distinct(F.array(F.col("_name"), F.when(F.length("_name") > 1, F.regexp_replace("_name", "s$", ""))))).alias("m"))
    by_name = n.join(p, [*key, "m"]).filter("a <> b").select(*order("a", "b"))

    def by_set(arr: str, num: int, den: int, least: int) -> DataFrame:
        long = reps.select(*key, "_id", F.size(arr).alias("n"), F.explode(arr).alias("tok"))
        freq = long.groupBy(*key, "tok").agg(F.count("*").alias("freq"))
        sets = long.join(freq, [*key, "tok"]).groupBy(*key, "_id", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "tok"))).alias("o"))
        need = F.greatest(F.lit(least), F.floor((F.col("n") * num + den - 1) / den).cast("int"))
        probe = sets.filter(F.col("n") >= least).select(*key, F.col("_id").alias("a"), F.col("n").alias("na"), F.transform("o", lambda x: x["tok"]).alias("ta"), F.explode(F.slice("o", 1, F.col("n") - need + 1)).alias("p"))
        probe = probe.select(*key, "a", "na", "ta", F.col("p.tok").alias("tok"))
        whole = reps.select(*key, F.col("_id").alias("b"), F.col(arr).alias("tb"))
        index = whole.select(*key, "b", F.size("tb").alias("nb"), "tb", F.explode("tb").alias("tok"))
        hit = probe.join(index, [*key, "tok"]).filter("a <> b and na <= nb").withColumn("k", F.size(F.array_intersect("ta", "tb")))
        return hit.filter((F.col("k") >= least) & (F.col("k") * den >= F.col("na") * num)).select(*order("a", "b"))

    return by_name.unionByName(by_set("_kw", 1, 2, 2)).unionByName(by_set("_pa", 3, 5, 1)).distinct()


def record_classes(dims: DataFrame, key: list[str], dim_id: str, name: str, keywords: str, paths: str) -> DataFrame:
    """(dim_id, class_id, n_links) of every named record: the representative it stands under in ``fuzzy_pairs``, and with how many records it may be merged.

    Records alike may be merged with each other and with the same others, so two records may be merged if their classes are
    equal or are a pair: nothing of a class is ever paired row by row. Where a part of ``key`` is null a record is alone.
    """
    rows = _merge_rows(dims, key, dim_id, name, keywords, paths)
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    alike = [*key, "_name", "_kw", "_pa"]
    reps = rows.filter(whole).groupBy(*alike).agg(F.min("_id").alias("class_id"), F.count("*").alias("n"))
    pairs = fuzzy_pairs(dims, key, dim_id, name, keywords, paths)
    ways = pairs.select(F.explode(F.array(F.struct(F.col("left_id").alias("class_id"), F.col("right_id").alias("other")), F.struct(F.col("right_id").alias("class_id"), F.col("left_id").alias("other")))).alias("w")).select("w.*")
    linked = ways.join(reps.select(F.col("class_id").alias("other"), "n"), "other").groupBy("class_id").agg(F.sum("n").alias("near"))
    classes = reps.join(linked, "class_id", "left").select(*alike, "class_id", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return rows.join(classes, alike, "left").select(F.col("_id").alias(dim_id), F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def phrase_ranks(docs: DataFrame, doc_id: str, text: str, candidates: list[tuple[str, list[str]]]) -> DataFrame:
    """(doc_id, candidate, score, rank) of each candidate with a positive score.

    100 for the candidate as it stands or as a whole phrase, 60 for a whole-phrase hit of an alias of two or more words (the
    candidate itself is one), 1 per distinct shared token. Ranks go by score, then by the order of the list. The list is a
    literal, scored within the row: no join.
    """
    low, phr = F.lower(text), T.phrase(F.col(text))
    toks = T.tokens(F.col(text))
    entries = []
    for i, (name, aliases) in enumerate(candidates):
        many = [a for a in dict.fromkeys([name, name.replace("_", " "), *aliases])]
        as_phrase = lambda s: T.phrase(F.lit(s))
        padded = F.concat(F.lit(" "), F.col("_p"), F.lit(" "))
        hits = [(F.size(F.split(as_phrase(a), " ")) >= 2) & F.contains(padded, F.concat(F.lit(" "), as_phrase(a), F.lit(" "))) for a in many]
        literal = F.contains(F.col("_l"), F.lit(name.lower())) | ((as_phrase(name) != "") & F.contains(padded, F.concat(F.lit(" "), as_phrase(name), F.lit(" "))))
        any_hit = hits[0]
        for h in hits[1:]:
            any_hit = any_hit | h
        score = F.when(literal, 100).otherwise(0) + F.when(any_hit, 60).otherwise(0) + F.size(F.array_intersect("_t", T.tokens(F.lit(name))))
        entries.append(F.struct((-score).alias("neg"), F.lit(i).alias("i"), F.lit(name).alias("candidate")))
    prepared = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id), F.inline(F.array(F.struct(low.alias("_l"), phr.alias("_p"), toks.alias("_t")))))
    ranked = prepared.select(doc_id, F.posexplode(F.array_sort(F.filter(F.array(*entries), lambda e: e["neg"] < 0))).alias("r", "e"))
    return ranked.select(doc_id, F.col("e.candidate").alias("candidate"), (-F.col("e.neg")).cast("bigint").alias("score"), (F.col("r") + 1).cast("bigint").alias("rank"))


def with_fallback(matches: Column, any_other: Column, everything: Column) -> Column:
    """The matches; all candidates where none matched but something else did; else none."""
    return F.when(F.size(matches) > 0, matches).when(any_other, everything).otherwise(F.slice(everything, 1, 0))


def unseen(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key hasn't been processed (resume); a null key has never been."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): added, removed, changed or unchanged, by a full join of two snapshots with unique keys."""
    a, b = old.select(F.col(key).alias("_k"), F.col(digest).alias("_a"), F.lit(True).alias("_x")), new.select(F.col(key).alias("_k"), F.col(digest).alias("_b"), F.lit(True).alias("_y"))
    status = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, "_k", "full").select(F.col("_k").alias(key), status.alias("status"))


def version_skew(current: DataFrame, saved: DataFrame, name: str, version: str) -> DataFrame:
    """(name, warning) where a saved snapshot names another version than the current one, or none is there."""
    s = saved.select(name, F.col(version).alias("_saved"))
    j = current.select(name, F.col(version).alias("_now")).join(s, name, "full")
    w = F.when(F.col("_saved").isNull(), F.lit("not in snapshot")).when(F.col("_now").isNull(), F.lit("missing now")).when(
        F.col("_saved") != F.col("_now"), F.format_string("snapshot has v%s, current is v%s", F.col("_saved").cast("string"), F.col("_now").cast("string"))
    )
    return j.select(name, w.alias("warning")).filter("warning is not null")


def live(cached_at: Column, now: Column, ttl_hours: float) -> Column:
    """Not expired: a ttl of 0 or less never expires, nor does a missing time."""
    if ttl_hours <= 0:
        return F.lit(True)
    return cached_at.isNull() | (now - F.make_dt_interval(hours=F.lit(int(ttl_hours)), secs=F.lit((ttl_hours % 1) * 3600)) <= cached_at)


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str, digest: str, cached_at: str, now: Column, ttl_hours: float) -> DataFrame:
    """wanted with hit: the cache holds the key with the same digest and isn't expired."""
    c = cache.filter(live(F.col(cached_at), now, ttl_hours)).select(key, digest).distinct().withColumn("_hit", F.lit(True))
    return wanted.join(c, [key, digest], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def same_fingerprint(a: list[Column], b: list[Column]) -> Column:
    """Null-safe equality of all hashes."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out


def consistency(index: DataFrame, listing: DataFrame, key: str, readable: str) -> DataFrame:
    """(key, problem): entries of the index without a file, files without an entry, unreadable files."""
    i, f = index.select(key).distinct().withColumn("_i", F.lit(True)), listing.select(key, F.col(readable).alias("_ok")).withColumn("_f", F.lit(True))
    p = F.when(F.col("_f").isNull(), "missing").when(F.col("_i").isNull(), "orphaned").when(~F.coalesce("_ok", F.lit(False)), "corrupt")
    return i.join(f, key, "full").select(key, p.alias("problem")).filter("problem is not null")


def blocked(decisions: DataFrame, checks: DataFrame, action: str, status: str) -> DataFrame:
    """One row (blocked): something is to be verified first and a check is pending, or there are none."""
    need = decisions.agg(F.coalesce(F.bool_or(F.col(action) == "verify_first"), F.lit(False)).alias("need"))
    open_ = checks.agg((F.coalesce(F.bool_or(F.col(status) == "pending"), F.lit(False)) | (F.count("*") == 0)).alias("open"))
    return need.select(F.lit(1).alias("k"), "need").join(open_.select(F.lit(1).alias("k"), "open"), "k").select((F.col("need") & F.col("open")).alias("blocked"))


def first_by_priority(rows: DataFrame, key: list[str], priority: Column) -> DataFrame:
    """One row per key, that of the smallest priority, by aggregation."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*cols), priority).alias("_w")).select(*key, "_w.*")


def model_hint(texts: DataFrame, text_id: str, text: str, models: list[dict], allowed: list[str]) -> DataFrame:
    """(text_id, hint): the type that the first referenced model gives, or null.

    A model is referenced if any of its references occurs in the text, or if it has none. Its own type goes before its
    hints; a model without an allowed one is passed over. The list is a literal.
    """
    low, out = F.lower(F.col(text)), F.lit(None).cast("string")
    for m in reversed(models):
        hint = next((h for h in [m.get("development_type", ""), *m.get("development_types", []), *m.get("hints", [])] if h and h.strip().lower() in allowed), None)
        refs = [r.strip().lower() for r in (m.get(k, "") for k in ("name", "id", "summary", "description")) if r and r.strip()]
        if hint is None:
            continue
        hit = F.lit(not refs)
        for r in refs:
            hit = hit | F.contains(low, F.lit(r))
        out = F.when(hit, F.lit(hint.strip().lower())).otherwise(out)
    return texts.select(text_id, out.alias("hint"))


def symbol_matches(lines: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """(symbol, path, line_no, line): up to ``most`` lines holding a symbol as a word, by path and line.

    lines (path, line_no, line) and symbols (symbol) meet on words, so no line is compared with every symbol.
    """
    w = lines.select("path", "line_no", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"(\w+)"), 1))).alias("symbol"))
    hit = w.join(symbols.select("symbol").distinct(), "symbol")
    return hit.withColumn("_r", F.row_number().over(W.partitionBy("symbol").orderBy("path", "line_no"))).filter(F.col("_r") <= most).drop("_r").select("symbol", "path", "line_no", "line")
