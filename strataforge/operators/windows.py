"""Ordered operators. Where the best few rows of a key are wanted they come from aggregates; row order within one
document is handled inside its array, so no window is ever larger than one document, version list or batch run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Budget of a batch and its most members.
BUDGET, MEMBERS = 3000, 15


def batches(rows: DataFrame, key: list[str], order: str, weight: str, budget: int = BUDGET, members: int = MEMBERS) -> DataFrame:
    """(key, order, batch): consecutive rows of a run in batches of at most ``budget`` and ``members`` (0-based numbers).

    A row over the budget is a batch of its own and closes the open one. The fold runs over the ordered array of one run
    (``key``), in the JVM; choose keys so that a run is what is processed at a time, such as a day of a repository.
    Null weights count 0.
    """
    item = F.struct(F.col(order).alias("o"), F.coalesce(F.col(weight), F.lit(0)).cast("bigint").alias("w"))
    runs = rows.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = "named_struct('b', -1L, 'w', 0L, 'n', 0, 'closed', true, 'out', cast(array() as array<bigint>))"
    alone = f"x.w > {budget}"
    joins = f"not acc.closed and acc.w + x.w <= {budget} and acc.n < {members}"
    b = f"if({alone}, acc.b + 1, if({joins}, acc.b, acc.b + 1))"
    step = f"""named_struct('b', {b}, 'w', if({alone}, 0L, if({joins}, acc.w + x.w, x.w)), 'n', if({alone}, 0, if({joins}, acc.n + 1, 1)),
      'closed', {alone}, 'out', concat(acc.out, array({b})))"""
    folded = runs.select(*key, "items", F.expr(f"aggregate(items, {zero}, (acc, x) -> {step}, acc -> acc.out)").alias("bs"))
    return folded.select(*key, F.inline(F.arrays_zip(F.transform("items", lambda x: x["o"]).alias("o"), F.col("bs").alias("batch")))).withColumnRenamed("o", order)


def latest_version(files: DataFrame, key: list[str], version: str, size: str, valid: Column | None = None) -> DataFrame:
    """The row of the highest version that isn't empty (and is valid) per key; keys without one are left out."""
    ok = files.filter(F.col(size) > 0)
    if valid is not None:
        ok = ok.filter(valid)
    rest = [c for c in files.columns if c not in key]
    return ok.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("_w")).select(*key, "_w.*")


def retained(files: DataFrame, key: list[str], version: str, accepted: Column, keep: int = 3) -> DataFrame:
    """files with ``keep``: the newest ``keep`` versions of a key and every accepted one."""
    newest = W.partitionBy(*key).orderBy(F.desc(version))
    return files.withColumn("keep", (F.row_number().over(newest) <= keep) | F.coalesce(accepted, F.lit(False)))


def evicted(cache: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """Keys of the oldest entries beyond ``most``, by time and key; 0 or less is unlimited. The threshold is found by a top-k,
    the entries aren't sorted in one place."""
    if most <= 0:
        return cache.select(key).limit(0)
    mark = F.struct(F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**62))).alias("t"), F.col(key).alias("k"))
    edge = cache.select(mark.alias("m")).orderBy(F.desc("m")).limit(most).agg(F.min("m").alias("edge"), F.count("*").alias("n"))
    return cache.select(key, mark.alias("m"), F.lit(1).alias("_j")).join(F.broadcast(edge.withColumn("_j", F.lit(1))), "_j").filter((F.col("m") < F.col("edge")) & (F.col("n") == most)).select(key)


def neighbours(rows: DataFrame, key: list[str], item: str, bucket: Column) -> DataFrame:
    """(key, item, before, after): the items next to each item (unique within a key) in its key; null at the ends.

    bucket must not fall as items rise. Neighbours are looked up within a bucket and then among the ends of the buckets, so a
    key that holds a third of all rows is sorted in as many parts as it has buckets.
    """
    x = rows.select(*key, item, bucket.alias("_b"))
    inside = W.partitionBy(*key, "_b").orderBy(item)
    x = x.select("*", F.lag(item).over(inside).alias("_l"), F.lead(item).over(inside).alias("_r"))
    ends = x.groupBy(*key, "_b").agg(F.min(item).alias("lo"), F.max(item).alias("hi"))
    along = W.partitionBy(*key).orderBy("_b")
    ends = ends.select(*key, "_b", F.lag("hi").over(along).alias("_lb"), F.lead("lo").over(along).alias("_rb"))
    return x.join(ends, [*key, "_b"]).select(*key, item, F.coalesce("_l", "_lb").alias("before"), F.coalesce("_r", "_rb").alias("after"))


def next_stage(stages: list[str], done: Column) -> Column:
    """The first stage that isn't among the completed ones, or null."""
    return F.get(F.array_except(F.lit(stages), F.coalesce(done, F.array().cast("array<string>"))), F.lit(0))


def arbitrated(facts: DataFrame, key: list[str], fact_id: str, statement: str, rank: list[Column], least: float = 0.3) -> DataFrame:
    """(fact_id, winner_id, outcome): per key the fact of the smallest rank wins (then the smaller id).

    The others are dropped, unless fewer than ``least`` of the words (of the larger set) are shared with the winner:
    such a fact says something else and is kept beside it.
    """
    order = F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)), F.col(fact_id).alias("id"))
    words = F.array_distinct(F.filter(F.split(F.lower(F.trim(F.coalesce(F.col(statement), F.lit("")))), r"\s+"), lambda w: w != ""))
    f = facts.select(*key, F.col(fact_id), order.alias("_o"), words.alias("_w"))
    best = f.groupBy(*key).agg(F.min(F.struct("_o", "_w")).alias("_b"))
    j = f.join(best, key)
    shared = F.coalesce(F.try_divide(F.size(F.array_intersect("_w", "_b._w")), F.greatest(F.size("_w"), F.size("_b._w"))), F.lit(0.0))
    outcome = F.when(F.col("_o") == F.col("_b._o"), "winner").when(shared < least, "kept").otherwise("dropped")
    return j.select(fact_id, F.col("_b._o.id").alias("winner_id"), outcome.alias("outcome"))


def sections(docs: DataFrame, doc_id: str, text: str, heading: str = r"^#{1,6}\s+(.+?)\s*$") -> DataFrame:
    """(doc_id, section_no, title, n_lines): the lines below each Markdown heading; 0 and '' are before the first.

    Worked out on the array of a document's lines; documents aren't sorted or windowed. Null texts have none.
    """
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    title = lambda x: F.regexp_extract(x, heading, 1)
    heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), title(x).alias("t"))), lambda h: h["t"] != "")
    base = docs.filter(F.col(text).isNotNull()).select(doc_id, F.size(lines).alias("_n"), F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("t"))), heads).alias("_h"))
    upto = F.coalesce(F.get("_h", F.col("section_no") + 1)["i"], F.col("_n"))
    return base.select(doc_id, "_n", "_h", F.posexplode("_h").alias("section_no", "h")).select(doc_id, F.col("section_no").cast("bigint").alias("section_no"), F.col("h.t").alias("title"), (upto - F.col("h.i") - 1).cast("bigint").alias("n_lines"))


def section_bodies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, section_no, title, content) split at '## ' headings; a part without one is titled by its first 50 characters."""
    strip = lambda c: F.trim(c, F.lit(" \t\r\n"))
    parts = F.filter(F.transform(F.split(text, r"(?m)(?=^##\s+)"), strip), lambda p: p != "")
    p = docs.filter(F.col(text).isNotNull()).select(doc_id, F.posexplode(parts).alias("section_no", "p"))
    first = F.substring_index("p", "\n", 1)
    headed = F.startswith("p", F.lit("## "))
    body = F.when(F.contains("p", F.lit("\n")), strip(F.regexp_replace(F.col("p"), r"(?s)^[^\n]*\n", ""))).otherwise("")
    return p.select(doc_id, F.col("section_no").cast("bigint").alias("section_no"), F.when(headed, strip(F.substr(first, F.lit(4)))).otherwise(F.substring(first, 1, 50)).alias("title"), F.when(headed, body).otherwise(F.col("p")).alias("content"))


def low_confidence(docs: DataFrame, doc_id: str, text: str, marks: tuple[str, ...] = ("confidence:", "low")) -> DataFrame:
    """(doc_id, context): the line before each line with all the marks, or that line itself where there is none."""
    lines = F.split(text, r"\r?\n")
    pairs = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.trim(F.coalesce(F.get(lines, i - 1), F.lit(""))).alias("before")))
    hit = docs.filter(F.col(text).isNotNull()).select(doc_id, F.explode(pairs).alias("p"))
    for m in marks:
        hit = hit.filter(F.contains(F.lower("p.line"), F.lit(m)))
    return hit.select(doc_id, F.when(F.col("p.before") != "", F.col("p.before")).otherwise(F.trim("p.line")).alias("context")).distinct()


def bullets_after(text: Column, label: str) -> Column:
    """Bullets right below the first line that is the label and a colon, blank lines skipped, distinct without case."""
    lines = F.split(text, r"\r?\n")
    at = F.array_position(F.transform(lines, lambda x: F.trim(x).rlike(rf"(?i)^[-*]?\s*\Q{label}\E\s*:\s*$")), True)
    below = F.filter(F.slice(lines, at.cast("int") + 1, F.greatest(F.size(lines) - at.cast("int"), F.lit(0))), lambda x: F.trim(x) != "")
    stop = F.array_position(F.transform(below, lambda x: x.rlike(r"^\s*[-*]\s+.+$")), False)
    run = F.when(stop > 0, F.slice(below, 1, stop.cast("int") - 1)).otherwise(below)
    from strataforge.operators.dedup import ordered_distinct_ci

    return F.when(at > 0, ordered_distinct_ci(F.transform(run, lambda x: F.regexp_extract(x, r"^\s*[-*]\s+(.+)$", 1)))).otherwise(F.array().cast("array<string>"))
