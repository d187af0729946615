"""The best representative of each duplicate group, field by field.

A survivor is the smallest row under an order of (trust, currency, id) that differs by field, so each group
costs one partial aggregation whatever its size: nothing of a group is ever collected.

``survivors`` orders by stated timestamps with missing ones last. ``most_current`` is currency reasoning for rows without
one, field by field: which value usually follows which is learned from the transitions between timestamped rows of all
groups, a group's values are ordered by reachability in that graph (cycles are no order), and the row of a topologically
last one is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.text import nonblank
from strataforge.llm.setjoin import keyword_set, path_set
from strataforge.operators.windows import neighbours
from strataforge.session import shared_dir

_LAST = 2**62


def name_key(c: Column) -> Column:
    """Case, white space, hyphen, underscore and then one final s ignored; null for blank names."""
    squeezed = F.regexp_replace(F.lower(c), r"(?U)[\s\-_]+", "")
    return F.when(nonblank(c), F.regexp_replace(squeezed, "s$", ""))


def _filled(c: Column) -> Column:
    """An array with at least one element that isn't blank; false for null."""
    return F.coalesce(F.exists(c, lambda e: nonblank(e)), F.lit(False))


def ranked(domains: DataFrame, trust: DataFrame) -> DataFrame:
    """Domains with their group key, trust (smaller first, unknown last) and recency (smaller first, null last)."""
    known = trust.filter(F.col("source").isNotNull()).groupBy("source").agg(F.min("trust_rank").cast("long").alias("trust"))
    return (
        domains.withColumn("key", name_key(F.col("domain_name")))
        .filter(F.col("key").isNotNull() & F.col("repo_id").isNotNull())
        .join(known, "source", "left")
        .withColumn("trust", F.coalesce("trust", F.lit(_LAST)))
        .withColumn("recency", F.coalesce(-F.unix_micros(F.col("seen_at").cast("timestamp")), F.lit(_LAST)))
    )


def _firsts() -> dict[str, tuple[Column, Column]]:
    """Per field: when a row can survive, and the order in which it does."""
    return {
        "description": (nonblank(F.col("description")), F.struct("trust", "recency", "domain_id")),
        "keywords": (_filled(F.col("keywords")), F.struct("recency", "trust", "domain_id")),
        "paths": (_filled(F.col("paths")), F.struct((-F.size(path_set(F.col("paths")))).alias("fewest"), "trust", "recency", "domain_id")),
    }


def survivors(domains: DataFrame, trust: DataFrame) -> DataFrame:
    """(group_id, field_name, from_id): the row of each group of two or more whose value survives.

    Groups: equal repo_id and name key. No row for a field that is blank in the whole group. Ties end with the smaller
    domain_id; rows with a null repo_id, a null domain_id or a blank name are in no group.
    """
    aggs = [F.min(F.when(ok, order)).alias(f) for f, (ok, order) in _firsts().items()]
    groups = (
        ranked(domains.filter(F.col("domain_id").isNotNull()), trust)
        .groupBy("repo_id", "key")
        .agg(F.min("domain_id").alias("group_id"), F.count("*").alias("n"), *aggs)
        .filter("n >= 2")
    )
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.domain_id").alias("from_id")) for f in _firsts()))
    return groups.select("group_id", F.explode(each).alias("x")).select("group_id", "x.field_name", "x.from_id").filter(F.col("from_id").isNotNull())


def surviving_records(domains: DataFrame, trust: DataFrame) -> DataFrame:
    """One built record per group: (group_id, repo_id, domain_name, description, keywords, paths)."""
    s = survivors(domains, trust)
    own = domains.select(F.col("domain_id").alias("from_id"), "description", "keywords", "paths")
    values = (
        s.join(own, "from_id")
        .groupBy("group_id")
        .agg(*(F.max(F.when(F.col("field_name") == f, F.struct(F.col(f).alias("v"))))["v"].alias(f) for f in ("description", "keywords", "paths")))
    )
    heads = domains.select(F.col("domain_id").alias("group_id"), "repo_id", "domain_name")
    return heads.join(s.select("group_id").distinct(), "group_id").join(values, "group_id", "left").select("group_id", "repo_id", "domain_name", "description", "keywords", "paths")


#: Time of which the values of a group are put in order in one task.
_SPAN_US = 30 * 86_400 * 10**6


def transitions(rows: DataFrame, group: list[str], value: str, at: str) -> DataFrame:
    """(v, w, n): in how many places of all groups the value v was followed by w, the next one in time.

    Only what follows next is counted, so a group gives as many transitions as it has times, not pairs of its values; further
    ones follow by reachability. A time at which a group has several values names no current one and is passed over.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    seen = rows.filter(F.col(value).isNotNull() & F.col(at).isNotNull()).groupBy(*group, t.alias("t")).agg(F.min(value).alias("v"), F.max(value).alias("hi")).filter("v = hi")
    items = seen.select(*group, F.struct("t", "v").alias("x"))
    near = neighbours(items, group, "x", F.floor(F.col("x.t") / _SPAN_US))
    return near.filter(F.col("before.v") != F.col("x.v")).groupBy(F.col("before.v").alias("v"), F.col("x.v").alias("w")).agg(F.count("*").alias("n"))


def _net(rows: DataFrame, group: list[str], value: str, at: str) -> DataFrame:
    """(x, y, net), x < y: how many transitions more lead from x to y than back."""
    lo, hi = F.least("v", "w"), F.greatest("v", "w")
    return transitions(rows, group, value, at).groupBy(lo.alias("x"), hi.alias("y")).agg(F.sum(F.when(F.col("v") == lo, F.col("n")).otherwise(-F.col("n"))).alias("net"))


class Precedence:
    """The learned graph: v precedes w where that transition was seen more often than the reverse.

    Only values of two or more groups are in it: within one group times are an order already, and a value of its own tells
    nothing about others, so between two others it is passed over. The graph is closed by doubling: w is later than v if a
    path of any length leads there and none back (``order``).
    """

    def __init__(self, rows: DataFrame, group: list[str], value: str, at: str):
        shared_dir(rows.sparkSession)
        of = rows.filter(F.col(value).isNotNull())
        for g in group:
            of = of.filter(F.col(g).isNotNull())
        key = F.xxhash64(*group)
        shared = of.groupBy(F.col(value).alias("_v")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo <> hi").select("_v")
        net = _net(of.join(shared, of[value] == shared["_v"], "left_semi"), group, value, at).filter("net <> 0")
        x_first = F.col("net") > 0
        reach, n = net.select(F.when(x_first, F.col("x")).otherwise(F.col("y")).alias("v"), F.when(x_first, F.col("y")).otherwise(F.col("x")).alias("w")).checkpoint(), -1
        while n != (n := reach.count()):
            further = reach.select("v", F.col("w").alias("m")).join(reach.select(F.col("v").alias("m"), "w"), "m").filter("v <> w").select("v", "w")
            reach = reach.unionByName(further).distinct().checkpoint()
        back = reach.select(F.col("v").alias("w"), F.col("w").alias("v"))
        self.order = reach.join(back, ["v", "w"], "left_anti").checkpoint()  # values on a cycle are in no order


def _field_values(domains: DataFrame) -> DataFrame:
    """A row per record and filled field: (field_name, repo_id, key, domain_id, seen_at, v)."""
    digest = lambda c: F.md5(F.concat_ws("\x1f", c))
    values = {
        "source": F.when(nonblank(F.col("source")), F.col("source")),
        "description": F.when(nonblank(F.col("description")), digest(F.trim("description"))),
        "keywords": F.when(_filled(F.col("keywords")), digest(keyword_set(F.col("keywords")))),
        "paths": F.when(_filled(F.col("paths")), digest(path_set(F.col("paths")))),
    }
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.concat(F.lit(f + ":"), v).alias("v")) for f, v in values.items()))
    return domains.select("repo_id", "key", "domain_id", "seen_at", F.explode(each).alias("x")).select("repo_id", "key", "domain_id", "seen_at", "x.field_name", "x.v").filter(F.col("v").isNotNull())


def most_current(domains: DataFrame) -> DataFrame:
    """(group_id, field_name, current_id, by): the row with the most current value of each field (source, description,
    keywords, paths) in each group of two or more; no row for a field that is blank in the whole group.

    Among rows with a timestamp the latest is known. A row without one is more current if its value is reachable from the
    value of that row in the field's learned graph, and not the reverse; of several one is taken whose value none of the
    others follows. by is 'time' or 'currency' (also where no row has a timestamp); ties end with the smaller id.
    """
    keyed = domains.withColumn("key", name_key(F.col("domain_name"))).filter(F.col("key").isNotNull() & F.col("repo_id").isNotNull() & F.col("domain_id").isNotNull())
    group = ["field_name", "repo_id", "key"]
    groups = keyed.groupBy("repo_id", "key").agg(F.min("domain_id").alias("group_id"), F.count("*").alias("n")).filter("n >= 2").drop("n")
    rows = _field_values(keyed)
    learned = Precedence(rows, group, "v", "seen_at")
    own = rows.join(groups, ["repo_id", "key"]).drop("repo_id", "key")
    g = ["group_id", "field_name"]
    timed = own.filter(F.col("seen_at").isNotNull()).groupBy(*g).agg(F.min(F.struct((-F.unix_micros(F.col("seen_at").cast("timestamp"))).alias("t"), "domain_id", "v")).alias("t")).select(*g, F.col("t.v").alias("v0"), F.col("t.domain_id").alias("id0"))
    undated = own.filter(F.col("seen_at").isNull()).groupBy(*g, "v").agg(F.min("domain_id").alias("id"))
    # the candidates of a group: the latest value, and the other ones without a timestamp
    rest = undated.join(timed.select(*g, "v0"), g, "left").filter(F.col("v0").isNull() | (F.col("v0") != F.col("v"))).select(*g, "v", "id", F.lit(False).alias("dated"), F.col("v0").isNotNull().alias("known"))
    c = timed.select(*g, F.col("v0").alias("v"), F.col("id0").alias("id"), F.lit(True).alias("dated"), F.lit(True).alias("known")).unionByName(rest).checkpoint()
    # a candidate meets what follows its value, not every other one of its group
    later = c.select(*g, "v", "dated").join(learned.order, "v").join(c.select(*g, F.col("v").alias("w")), [*g, "w"], "left_semi")
    followed = later.select(*g, "v").distinct()
    passing = later.filter("dated").select(*g, F.col("w").alias("v"), F.lit(True).alias("passes")).distinct()
    left = c.join(followed, [*g, "v"], "left_anti").join(passing, [*g, "v"], "left").filter(F.col("dated") | ~F.col("known") | F.col("passes"))
    won = left.groupBy(*g).agg(F.min_by("dated", "id").alias("dated"), F.min("id").alias("current_id"))
    return won.select(*g, "current_id", F.when(F.col("dated"), "time").otherwise("currency").alias("by"))
