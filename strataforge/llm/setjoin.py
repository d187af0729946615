"""All pairs of records whose sets overlap by Jaccard >= num/den, within a table or between two: prefix-filtered join.

Plan, all of it in the JVM:

1. Records with the same set are one *class*, named by its smallest id, so a set that a third of all records carries
   takes part once.
2. Tokens are ordered by (document frequency over classes, hash); of a set of n tokens only the first
   ``n - ceil(t n) + 1`` can be the first common token of a qualifying pair, so only those are joined, and of those only the
   ones that occur in two classes. What is joined is (class, size, position) and a 128-bit signature, never the sets.
3. Candidates must share such a token, differ little enough in length, be able to reach the overlap from the position of
   that token on, and have signatures that differ in few enough bits. Only what is left fetches its sets, for exact
   verification on the tokens themselves. (Two tokens with one 64-bit hash would add candidates, not lose any.)
4. A token that starts many classes is split: one side is salted, the other repeated per salt. Classes of many records are
   split the same way when pairs of classes become pairs of records.

Null and blank elements, repeated elements: don't count. Null or empty sets: no pairs. Repeated rows (another id):
pairs with everything their copies pair with, and with the copies. An id given twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.text import squeeze
from strataforge.session import shared_dir

#: Classes with one prefix token beyond which its join is split, and the size of a part; records of a class in a part.
HOT, PART = 20_000, 1_000


def keyword_set(c: Column) -> Column:
    """Trimmed, lower-cased, distinct, sorted; null and blank elements dropped."""
    x = F.transform(c, lambda e: F.lower(squeeze(e)))
    return F.sort_array(F.array_distinct(F.filter(x, lambda e: e.isNotNull() & (e != ""))))


def path_element(e: Column) -> Column:
    e = F.translate(squeeze(e), "\\", "/")
    return F.regexp_replace(F.regexp_replace(e, r"^\./", ""), r"/+$", "")


def path_set(c: Column) -> Column:
    """Trimmed, backslash as slash, without a leading ./ and trailing /; distinct, sorted; blank ones dropped."""
    x = F.transform(c, path_element)
    return F.sort_array(F.array_distinct(F.filter(x, lambda e: e.isNotNull() & (e != ""))))


def set_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, id, toks) -> members (field, id, cid) and classes (field, cid, toks, copies)."""
    keyed = records.filter((F.size("toks") > 0) & F.col("id").isNotNull()).select("field", "id", "toks", F.unhex(F.md5(F.to_json("toks"))).alias("body"))
    shared_dir(records.sparkSession)
    classes = keyed.groupBy("field", "body").agg(F.min("id").alias("cid"), F.min_by("toks", "id").alias("toks"), F.count_distinct("id").alias("copies")).checkpoint()  # read by each step
    members = keyed.select("field", "id", "body").distinct().join(classes.select("field", "body", "cid"), ["field", "body"]).select("field", "id", "cid")
    return members, classes.select("field", "cid", "toks", "copies")


def _signature(half: int) -> Column:
    """One of two words of 64 bits in which each token of ``o`` sets a bit of one of them."""
    bit = "shiftleft(1L, cast(pmod(shiftright(x.tok, 8), 64) as int))"
    return F.expr(f"aggregate(o, 0L, (a, x) -> if(pmod(shiftright(x.tok, 40), 2) = {half}, a | {bit}, a))")


def _prefixes(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(field, cid, n, s0, s1, at, tok, parts[, side]): prefix tokens that occur in two classes or more."""
    key = [c for c in ("side", "field", "cid") if c in classes.columns]
    long = classes.select(*key, F.explode("toks").alias("t")).select(*key, F.xxhash64("t").alias("tok"))
    freq = long.groupBy("field", "tok").agg(F.count("*").alias("freq")).filter("freq > 1")
    ordered = (
        long.join(freq, ["field", "tok"], "left")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(1)).alias("freq"), "tok"))).alias("o"))  # bounded by one record's set
    )
    n = F.size("o")
    keep = n - F.floor((n * num + (den - 1)) / den).cast("int") + 1  # integer ceiling: exact at the bound
    return (
        ordered.select(*key, n.alias("n"), _signature(0).alias("s0"), _signature(1).alias("s1"), F.posexplode(F.slice("o", 1, keep)).alias("at", "p"))
        .filter("p.freq > 1")
        .select(*key, "n", "s0", "s1", "at", F.col("p.tok").alias("tok"), F.ceil(F.col("p.freq") / HOT).cast("int").alias("parts"))
    )


def similar_classes(classes: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """Pairs (field, cid_a, cid_b) of different sets with |A and B| / |A or B| >= num/den.

    Of one table each pair comes once, with cid_a < cid_b. With a column ``side`` (0 or 1) cid_a is of side 0 and cid_b of
    side 1, and equal sets are a pair too.
    """
    two = "side" in classes.columns
    p = _prefixes(classes, num, den).checkpoint()  # both sides of the join
    carried = ("cid", "n", "s0", "s1", "at")
    left, right = (p.filter("side = 0"), p.filter("side = 1")) if two else (p, p)
    a = left.select("field", "tok", *(F.col(c).alias(f"{c}_a") for c in carried), F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"))
    b = right.select("field", "tok", *(F.col(c).alias(f"{c}_b") for c in carried), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # |I| / (na + nb - |I|) >= num/den, in integers
    reach = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    both = F.col("n_a") + F.col("n_b")
    need = both * num
    differ = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b")))  # <= |A or B| - |A and B|
    met = a.join(b, ["field", "tok", "part"])
    met = met if two else met.filter("cid_a < cid_b")
    found = met.filter((F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (reach * (num + den) >= need) & ((both - differ) * (num + den) >= 2 * need))
    found = found.select("field", "cid_a", "cid_b").distinct()
    sets = lambda side, x: (classes.filter(f"side = {side}") if two else classes).select("field", F.col("cid").alias(f"cid_{x}"), F.col("toks").alias(f"toks_{x}"))
    common = F.size(F.array_intersect("toks_a", "toks_b"))
    full = found.join(sets(0, "a"), ["field", "cid_a"]).join(sets(1, "b"), ["field", "cid_b"])
    return full.filter(common * (num + den) >= (F.size("toks_a") + F.size("toks_b")) * num).select("field", "cid_a", "cid_b")


def _expanded(links: DataFrame, left: DataFrame, right: DataFrame, sizes_left: DataFrame, sizes_right: DataFrame) -> DataFrame:
    """Pairs of classes as pairs (field, cid_a, cid_b, l, r) of their records, a class cut into parts of PART records."""
    parts = lambda n: F.ceil(n / PART).cast("int")
    a = sizes_left.select("field", F.col("cid").alias("cid_a"), parts(F.col("copies")).alias("pa"))
    b = sizes_right.select("field", F.col("cid").alias("cid_b"), parts(F.col("copies")).alias("pb"))
    at = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    work = links.join(a, ["field", "cid_a"]).join(b, ["field", "cid_b"]).select("field", "cid_a", "cid_b", "pb", at("pa").alias("i")).select("field", "cid_a", "cid_b", "i", at("pb").alias("j"))
    part = lambda n: F.pmod(F.xxhash64("id"), parts(n)).cast("int")
    l = left.join(sizes_left, ["field", "cid"]).select("field", F.col("cid").alias("cid_a"), F.col("id").alias("l"), part(F.col("copies")).alias("i"))  # noqa: E741
    r = right.join(sizes_right, ["field", "cid"]).select("field", F.col("cid").alias("cid_b"), F.col("id").alias("r"), part(F.col("copies")).alias("j"))
    return work.join(l, ["field", "cid_a", "i"]).join(r, ["field", "cid_b", "j"])


def similar_pairs(records: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """(field, id, toks) -> every pair (field, id_a, id_b), id_a < id_b, of similar records."""
    members, classes = set_classes(records)
    same = classes.filter(F.col("copies") > 1).select("field", F.col("cid").alias("cid_a"), F.col("cid").alias("cid_b"))
    sizes = classes.select("field", "cid", "copies")
    pairs = _expanded(similar_classes(classes, num, den).unionByName(same), members, members, sizes, sizes)
    return pairs.filter((F.col("cid_a") != F.col("cid_b")) | (F.col("l") < F.col("r"))).select("field", F.least("l", "r").alias("id_a"), F.greatest("l", "r").alias("id_b"))


def similar_between(left: DataFrame, right: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """Two tables (field, id, toks) -> every pair (field, id_a, id_b) of a record of the left and a similar one of the right."""
    (ml, cl), (mr, cr) = set_classes(left), set_classes(right)
    classes = cl.withColumn("side", F.lit(0)).unionByName(cr.withColumn("side", F.lit(1)))
    pairs = _expanded(similar_classes(classes, num, den), ml, mr, cl.select("field", "cid", "copies"), cr.select("field", "cid", "copies"))
    return pairs.select("field", F.col("l").alias("id_a"), F.col("r").alias("id_b"))


def linked_records(records: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """One row per record with a non-empty set: (field, id, class_id, n_links).

    class_id is the smallest id with the very same set; n_links counts the similar records, copies included,
    without expanding them into pairs.
    """
    members, classes = set_classes(records)
    links = similar_classes(classes, num, den)
    both = links.unionByName(links.select("field", F.col("cid_b").alias("cid_a"), F.col("cid_a").alias("cid_b")))
    sizes = classes.select("field", F.col("cid").alias("cid_b"), "copies")
    n = both.join(sizes, ["field", "cid_b"]).groupBy("field", F.col("cid_a").alias("cid")).agg(F.sum("copies").alias("others"))
    per_class = classes.join(n, ["field", "cid"], "left").select("field", "cid", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.join(per_class, ["field", "cid"]).select("field", "id", F.col("cid").alias("class_id"), "n_links")


def domain_sets(domains: DataFrame) -> DataFrame:
    """The domains table as (field, id, toks), one row per record and set."""
    both = F.array(
        F.struct(F.lit("keywords").alias("field"), keyword_set(F.col("keywords")).alias("toks")),
        F.struct(F.lit("paths").alias("field"), path_set(F.col("paths")).alias("toks")),
    )
    return domains.select(F.col("domain_id").alias("id"), F.explode(both).alias("x")).select("x.field", "id", "x.toks")
