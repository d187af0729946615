"""Timestamps of many formats, precisions and zones as one UTC instant.

``interpretations`` gives every valid reading of a text as an array, in the JVM: regular expressions bring a text
into one canonical field list, the rest is integer arithmetic. ``resolve`` picks one reading per record by Viterbi over
the record order of its source: a reading costs what contradicts the source's stated habits, a change of format and a
step back in time cost extra.

Where a source states no date order, ``with_habits`` learns one from its unambiguous dates; it only tips the scales.

Viterbi is sequential, a source is not bounded. So the records of a source are cut into chunks by time; each chunk is
summed up as the matrix of cheapest paths from its first record's readings to its last record's, a source's matrices
are chained, and with both ends of each chunk fixed the chunks are solved on their own. The result is the one
that a single pass would give.
"""

from __future__ import annotations

from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataforge.session import shared_dir

FIRST_US, END_US = 946_684_800_000_000, 1_893_456_000_000_000  # 2000-01-01, 2030-01-01
#: Costs: a reading against the stated habit outweighs both changes that it can save on either side.
AGAINST_HABIT, SWITCH, BACKWARD = 100.0, 1.0, 2.0
#: The most that a learned habit costs: less than a change of format, so that neighbours can overturn it.
HABIT = 0.75
SLACK_US = 36 * 3600 * 10**6  # deliveries may be that much out of order at no cost
CHUNK_ROWS = 50_000

# Month names, by number.
MONTHS = {
    1: "jan january januar jänner ene enero", 2: "feb february februar febrero", 3: "mar march märz mär mrz marzo",
    4: "apr april abr abril", 5: "may mai mayo", 6: "jun june juni junio", 7: "jul july juli julio",
    8: "aug august ago agosto", 9: "sep sept september septiembre", 10: "oct october okt oktober octubre",
    11: "nov november noviembre", 12: "dec december dez dezember dic diciembre",
}
# Zone abbreviations with one usual meaning, in minutes east of UTC.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180,
    "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480,
    "hst": -600, "brt": -180, "jst": 540, "kst": 540, "ist": 330, "npt": 345, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? ?([ap]\.?m\.?)?"
_ZONE = r" ?([a-z]{1,5}|[+-]\d{2}(?::?\d{2})?)?(?:\[[^\]]*\])?"
_NAME = r"([a-zäé]{3,10})\.?"
_DAY = r"(?:[a-zäéáíó]{2,10}\.?,? +)?"
#: kind, pattern, canonical form kind|a|b|c|hour|minute|second|fraction|am or pm|zone
_FORMS = [
    ("n", r"^([+-]?\d+(?:\.\d+)?(?:e[+-]?\d+)?)(?: +[+-]\d{2}:?\d{2})?$", "n|$1||||||||"),
    ("y", r"^(\d{4})(?:[-/.]|年)(\d{1,2})(?:[-/.]|月)(\d{1,2})(?:[t ] *|日 *)" + _TIME + _ZONE + "$", "y|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("y", r"^(\d{4})(\d{2})(\d{2})[t ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?()" + _ZONE + "$", "y|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("e", r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}),? +" + _TIME + _ZONE + "$", "e|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("c", "^" + _DAY + _NAME + r" +(\d{1,2}) +" + _TIME + r"(?: +([a-z]{1,5}))? +(\d{4})" + _ZONE + "$", "c|$9|$1|$2|$3|$4|$5|$6|$7|$8$10"),
    ("c", "^" + _DAY + r"(\d{1,2})\.?(?: +|-)(?:de +)?" + _NAME + r"(?: +|-)(?:de +)?(\d{4}),? +" + _TIME + _ZONE + "$", "c|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("c", "^" + _DAY + _NAME + r" +(\d{1,2}),? +(\d{4}),? +" + _TIME + _ZONE + "$", "c|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("w", r"^(\d{4})-?w(\d{2})-?(\d)[t ]" + _TIME + _ZONE + "$", "w|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("o", r"^(\d{4})-(\d{3})()[t ]" + _TIME + _ZONE + "$", "o|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
]


def _days(y: str, m: str, d: str) -> str:
    """SQL: days since 1970-01-01 of a civil date; null if there is no such date."""
    yy = f"({y} - if({m} <= 2, 1, 0))"
    doe = f"(({yy} % 400) * 365 + ({yy} % 400) div 4 - ({yy} % 400) div 100 + (153 * ({m} + if({m} > 2, -3, 9)) + 2) div 5 + {d} - 1)"
    leap = f"({y} % 4 = 0 and ({y} % 100 != 0 or {y} % 400 = 0))"
    most = f"case when {m} in (4, 6, 9, 11) then 30 when {m} = 2 then if({leap}, 29, 28) else 31 end"
    return f"if({y} between 1 and 9999 and {m} between 1 and 12 and {d} between 1 and {most}, ({yy} div 400) * 146097 + {doe} - 719468, null)"


def _monday(y: str) -> str:
    """SQL: the Monday of the first ISO week of a year."""
    jan4 = _days(f"({y})", "1", "4")
    return f"({jan4} - pmod({jan4} + 3, 7))"


def _lookup(table: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def canonical(text: Column) -> Column:
    """kind|a|b|c|hour|minute|second|fraction|am or pm|zone, or null where no form fits."""
    t = F.lower(F.regexp_replace(F.translate(text, "−", "-"), r"(?U)^[\s\"'“”‘’`]+|[\s\"'“”‘’`]+$", ""))
    return F.coalesce(*(F.when(t.rlike(p), F.regexp_replace(t, p, form)) for _, p, form in _FORMS))


def _step_of(df: DataFrame, *columns: Column) -> DataFrame:
    """df with further columns, computed once: a generator is a border that neither a filter nor a projection is moved
    across, and without one each column would be repeated wherever a later one names it."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def interpretations(df: DataFrame, text: str, zone: str, date_order: str) -> DataFrame:
    """df with ``readings``: array<struct<fmt: int, us: bigint, cost: double>> of all valid readings in range.

    zone is the IANA zone of texts without one (null: such texts have no reading); date_order is dmy, mdy or null
    for numeric dates that end in the year. With an order stated, a date that is impossible in it has no reading; the
    other order, where valid too, is kept at a cost. Null, blank, date-only and unknown texts have an empty array.
    """
    month = _lookup({w: m for m, ws in MONTHS.items() for w in ws.split()})
    minutes = _lookup(ZONES)
    out = _step_of(df, F.split(canonical(F.col(text)), r"\|").alias("_f"))
    part = lambda i: F.get("_f", F.lit(i))
    num = lambda i: part(i).try_cast("int")
    out = _step_of(
        out,
        part(0).alias("_k"),
        F.when(part(0) == "n", part(1)).try_cast("decimal(38,9)").alias("_n"),
        num(1).alias("_a"),
        F.when(part(0) == "c", F.try_element_at(month, part(2))).otherwise(num(2)).alias("_b"),
        num(3).alias("_c"),
        num(4).alias("_h"),
        num(5).alias("_mi"),
        F.when(part(6) == "", F.lit(0)).otherwise(num(6)).alias("_s"),
        F.when(part(7) == "", F.lit(0)).otherwise(F.rpad(F.substring(part(7), 1, 6), 6, "0").try_cast("int")).alias("_us"),
        F.substring(part(8), 1, 1).alias("_ap"),
        F.when(part(9) == "", F.lit("")).otherwise(part(9)).alias("_z"),
    )
    hour = "case when _ap = '' then if(_h between 0 and 23, _h, null) when _h between 1 and 12 then _h % 12 + if(_ap = 'p', 12, 0) end"
    tod = f"if(_mi between 0 and 59 and _s between 0 and 59, (({hour}) * 3600 + _mi * 60 + _s) * 1000000L + _us, null)"
    digits = F.regexp_replace("_z", ":", "")
    offset = F.when(
        digits.rlike(r"^[+-]\d{2}(\d{2})?$"),
        F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1)
        * (F.substring(digits, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0))),
    ).otherwise(F.try_element_at(minutes, F.col("_z")))
    civil = f"""case _k
      when 'y' then {_days("_a", "_b", "_c")}
      when 'c' then {_days("_a", "_b", "_c")}
      when 'w' then if(_c between 1 and 7 and _b between 1 and 52 + if({_monday("_a + 1")} - {_monday("_a")} = 371, 1, 0), {_monday("_a")} + (_b - 1) * 7 + _c - 1, null)
      when 'o' then if(_b between 1 and 365 + if(_a % 4 = 0 and (_a % 100 != 0 or _a % 400 = 0), 1, 0), {_days("_a", "1", "1")} + _b - 1, null)
      when 'e' then case lower({date_order}) when 'dmy' then {_days("_c", "_b", "_a")} when 'mdy' then {_days("_c", "_a", "_b")} end
    end"""
    out = _step_of(
        out,
        F.expr(tod).alias("_tod"),
        F.when(F.abs(offset) <= 18 * 60, offset).alias("_off"),
        F.expr(f"case when _k <> 'n' then {civil} end").alias("_day"),
        F.expr(f"case when _k = 'e' then {_days('_c', '_b', '_a')} end").alias("_dmy"),
        F.expr(f"case when _k = 'e' then {_days('_c', '_a', '_b')} end").alias("_mdy"),
    )

    def at(day: str) -> Column:
        wall = F.col(day).cast("bigint") * F.lit(86_400_000_000) + F.col("_tod")
        # a wall time that occurs twice is the first, a skipped one keeps the offset from before the change
        local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), F.coalesce(zone, F.lit("UTC"))))
        us = F.when(F.col("_z") != "", wall - F.col("_off").cast("bigint") * 60_000_000).when(F.col(zone).isNotNull(), local)
        return us

    out = _step_of(out, at("_day").alias("_i_day"), at("_dmy").alias("_i_dmy"), at("_mdy").alias("_i_mdy"))

    def instant(day: str) -> Column:
        us = F.col(f"_i{day}")
        return F.when((us >= FIRST_US) & (us < END_US), us)

    def reading(fmt: int, us: Column, cost: float) -> Column:
        return F.struct(F.lit(fmt).alias("fmt"), us.alias("us"), F.lit(cost).alias("cost"))

    scales = [(10, 1_000_000), (11, 1_000), (12, 1)]
    number = [F.floor(F.col("_n").cast("decimal(29,9)") * F.lit(k)).try_cast("bigint") for _, k in scales] + [F.floor(F.col("_n") / 1000).try_cast("bigint")]
    bare = F.when(F.col("_k") == "n", F.array(*(reading(10 + i, F.when((us >= FIRST_US) & (us < END_US), us), 0.0) for i, us in enumerate(number))))
    other = F.when(F.lower(date_order) == "dmy", instant("_mdy")).when(F.lower(date_order) == "mdy", instant("_dmy"))
    fmt = F.when(F.lower(date_order) == "dmy", 1).otherwise(2)
    stated = F.when(
        (F.col("_k") == "e") & F.lower(date_order).isin("dmy", "mdy"),
        F.when(
            instant("_day").isNotNull(),
            F.array(
                F.struct(fmt.alias("fmt"), instant("_day").alias("us"), F.lit(0.0).alias("cost")),
                F.struct((3 - fmt).alias("fmt"), F.when(other != instant("_day"), other).alias("us"), F.lit(AGAINST_HABIT).alias("cost")),
            ),
        ),
    )
    unstated = F.when(F.col("_k") == "e", F.array(reading(1, instant("_dmy"), 0.0), reading(2, F.when(F.col("_dmy") != F.col("_mdy"), instant("_mdy")).when(F.col("_dmy").isNull(), instant("_mdy")), 0.0)))
    plain = F.array(reading(3, instant("_day"), 0.0))
    stated_order = F.coalesce(F.lower(date_order).isin("dmy", "mdy"), F.lit(False))
    chosen = F.when(F.col("_k") == "n", bare).when((F.col("_k") == "e") & stated_order, stated).when(F.col("_k") == "e", unstated).otherwise(plain)
    kept = F.filter(F.coalesce(chosen, F.array().cast("array<struct<fmt:int,us:bigint,cost:double>>")), lambda r: r["us"].isNotNull())
    return _step_of(out, kept.alias("readings")).select(*df.columns, "readings")


# ---- Viterbi over the record order of each source


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    us = pdf[["us0", "us1"]].to_numpy(np.float64)
    cost = pdf[["cost0", "cost1"]].to_numpy(np.float64)
    cost[np.isnan(us)] = np.inf
    return us, cost, pdf[["fmt0", "fmt1"]].to_numpy(np.float64)


def _step(us, fmt, i: int, j: int) -> np.ndarray:
    """Costs of going from each reading of record i to each of record j."""
    switch = (fmt[i][:, None] != fmt[j][None, :]) * SWITCH
    back = (us[j][None, :] < us[i][:, None] - SLACK_US) * BACKWARD
    return switch + back


def _forward(us, cost, fmt, start: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Cheapest cost of each reading of the last record, and where it came from.

    Two neighbours with one reading each add the same to every path and are left out.
    """
    single = np.isinf(cost[:, 1])
    value, came = start, {}
    for j in np.flatnonzero(~(single[1:] & single[:-1])) + 1:
        total = value[:, None] + _step(us, fmt, j - 1, j) + cost[j][None, :]
        came[j] = np.argmin(total, axis=0)
        value = np.min(total, axis=0)
    return value, came


_ENDS = ", ".join(f"{e}_{c}{k} double" for e in ("first", "last") for c in ("us", "fmt", "cost") for k in (0, 1))
_SUMMARY = f"source bigint, chunk bigint, m00 double, m01 double, m10 double, m11 double, {_ENDS}"


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["at", "rid"], kind="stable")
    us, cost, fmt = _arrays(pdf)
    m = np.full((2, 2), np.inf)
    for a in (0, 1):
        if np.isfinite(cost[0][a]):
            start = np.full(2, np.inf)
            start[a] = cost[0][a]
            m[a] = start if len(us) == 1 else _forward(us, cost, fmt, start)[0]
    row = {"source": pdf["source"].iloc[0], "chunk": pdf["chunk"].iloc[0], "m00": m[0, 0], "m01": m[0, 1], "m10": m[1, 0], "m11": m[1, 1]}
    for e, i in (("first", 0), ("last", -1)):
        for k in (0, 1):
            row |= {f"{e}_us{k}": us[i][k], f"{e}_fmt{k}": fmt[i][k], f"{e}_cost{k}": cost[i][k]}
    return pd.DataFrame([row])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Both ends of each chunk of one source, on the cheapest path through all of them."""
    pdf = pdf.sort_values("chunk")
    ms = pdf[["m00", "m01", "m10", "m11"]].to_numpy().reshape(-1, 2, 2)
    ends = {f"{e}_{c}": pdf[[f"{e}_{c}0", f"{e}_{c}1"]].to_numpy() for e in ("first", "last") for c in ("us", "fmt")}
    n = len(pdf)
    value, came = np.min(ms[0], axis=0), [np.argmin(ms[0], axis=0)]
    entry = [None]
    for i in range(1, n):
        us = np.vstack([ends["last_us"][i - 1], ends["first_us"][i]])
        fmt = np.vstack([ends["last_fmt"][i - 1], ends["first_fmt"][i]])
        into = value[:, None] + _step(us, fmt, 0, 1)
        entry.append(np.argmin(into, axis=0))
        total = np.min(into, axis=0)[:, None] + ms[i]
        came.append(np.argmin(total, axis=0))
        value = np.min(total, axis=0)
    a, b = [0] * n, [0] * n
    b[-1] = int(np.argmin(value))
    for i in range(n - 1, -1, -1):
        a[i] = int(came[i][b[i]])
        if i:
            b[i - 1] = int(entry[i][a[i]])
    return pd.DataFrame({"source": pdf["source"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "a": a, "b": b})


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["at", "rid"], kind="stable")
    us, cost, fmt = _arrays(pdf)
    n = len(us)
    pick = np.zeros(n, int)
    pick[0], pick[-1] = pdf["a"].iloc[0], pdf["b"].iloc[0]
    if n > 1:
        start = np.full(2, np.inf)
        start[pick[0]] = cost[0][pick[0]]
        _, came = _forward(us, cost, fmt, start)
        for j in range(n - 1, 0, -1):
            if j in came:
                pick[j - 1] = came[j][pick[j]] if j > 1 else pick[0]
    return pd.DataFrame({"rid": pdf["rid"].to_numpy(), "us": np.where(pick == 0, pdf["us0"], pdf["us1"])}).astype({"us": "int64"})


def chunked(rows: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """rows (source, at, rid, ...) with ``chunk``: consecutive records of a source, about ``size`` together.

    Units are the hours of a source; an hour of more than ``size`` records is taken apart into its instants, an instant of
    more into ranges of rid. Units are counted by aggregation and put together in order, so no source is sorted whole.
    """
    hour = F.floor(F.col("at") / 3_600_000_000).cast("bigint")
    counts = rows.groupBy("source", hour.alias("_h")).agg(F.count("*").alias("_n"))
    full = counts.filter(F.col("_n") > size).select("source", "_h", F.lit(True).alias("_full"))
    x = rows.withColumn("_h", hour).join(full, ["source", "_h"], "left")
    same = x.filter("_full").groupBy("source", "at").agg(F.count("*").alias("_n"), F.min("rid").alias("_lo"), F.max("rid").alias("_hi")).filter(F.col("_n") > size)
    x = x.join(same, ["source", "at"], "left")
    at = F.when(F.col("_full"), F.col("at")).otherwise(F.col("_h") * 3_600_000_000)
    width = F.greatest(F.lit(1), F.floor((F.col("_hi") - F.col("_lo")) / F.ceil(F.col("_n") / size))).cast("bigint")
    part = F.coalesce(F.floor((F.col("rid") - F.col("_lo")) / width), F.lit(0)).cast("bigint")
    x = x.withColumn("_a", at).withColumn("_b", part).drop("_h", "_full", "_n", "_lo", "_hi")
    units = x.groupBy("source", "_a", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("source").orderBy("_a", "_b")) - F.col("_n")
    return x.join(units.select("source", "_a", "_b", F.floor(before / size).cast("bigint").alias("chunk")), ["source", "_a", "_b"]).drop("_a", "_b")


def with_habits(read: DataFrame, source: str) -> DataFrame:
    """``readings`` in which the order that a source states nowhere but shows in its unambiguous dates costs less.

    A reading costs up to HABIT, by the share of the source's unambiguous dates in the other order: less than a change of
    format, so the neighbours can overturn it. Sources without an unambiguous date have no habit.
    """
    only = lambda fmt: F.count_if((F.size("readings") == 1) & (F.get("readings", F.lit(0))["fmt"] == fmt))
    seen = read.groupBy(F.col(source).alias("_s")).agg(only(1).alias("_dmy"), only(2).alias("_mdy")).filter("_dmy + _mdy > 0")
    r = F.get("readings", F.lit(0)), F.get("readings", F.lit(1))
    free = (F.size("readings") == 2) & (r[0]["cost"] == 0) & (r[1]["cost"] == 0) & r[0]["fmt"].isin(1, 2)
    against = lambda x: F.coalesce(F.try_divide(F.when(x["fmt"] == 1, F.col("_mdy")).otherwise(F.col("_dmy")), F.col("_dmy") + F.col("_mdy")), F.lit(0.0)) * HABIT
    learned = F.transform("readings", lambda x: F.struct(x["fmt"].alias("fmt"), x["us"].alias("us"), against(x).alias("cost")))
    joined = read.join(seen, F.col(source).eqNullSafe(F.col("_s")), "left")
    return joined.withColumn("readings", F.when(free, learned).otherwise(F.col("readings"))).select(*read.columns)


def resolve(df: DataFrame, rid: str, source: str, order: str, size: int = CHUNK_ROWS) -> DataFrame:
    """(rid, us): the chosen reading of each record that has one; records with an empty ``readings`` are left out.

    A null source is one of its own; records with a null order come first. rid must be unique; ties in order go by rid.
    """
    r = lambda i, c: F.get("readings", F.lit(i))[c]
    rows = df.filter(F.size("readings") > 0).select(
        F.col(rid).alias("rid"),
        F.coalesce(F.col(source).cast("bigint"), F.lit(-(2**62))).alias("source"),
        F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(-(2**62))).alias("at"),
        *(r(i, c).cast("bigint" if c == "us" else "double").alias(f"{c}{i}") for i in (0, 1) for c in ("us", "cost", "fmt")),
    )
    shared_dir(df.sparkSession)
    rows = chunked(rows.checkpoint(), size).checkpoint()  # counted, summed up and solved
    ends = rows.groupBy("source", "chunk").applyInPandas(_summary, _SUMMARY).groupBy("source").applyInPandas(_chain, "source bigint, chunk bigint, a int, b int")
    return rows.join(ends, ["source", "chunk"]).groupBy("source", "chunk").applyInPandas(_solve, "rid bigint, us bigint")


def commit_instants(commits: DataFrame, repos: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """(raw_id, utc_us): each commit row whose timestamp names one instant."""
    known = F.when(F.col("tz_name").isin(sorted(available_timezones())), F.col("tz_name"))  # an unknown zone would end the job
    places = repos.filter(F.col("repo_id").isNotNull()).groupBy("repo_id").agg(F.min(known).alias("tz_name"), F.min("date_order").alias("date_order"))
    read = interpretations(commits.select("raw_id", "repo_id", "ingested_at", "commit_timestamp").join(places, "repo_id", "left"), "commit_timestamp", "tz_name", "date_order")
    shared_dir(commits.sparkSession)
    read = read.select("raw_id", "repo_id", "ingested_at", "readings").filter(F.size("readings") > 0).checkpoint()  # texts are read once
    return resolve(with_habits(read, "repo_id"), "raw_id", "repo_id", "ingested_at", size).select(F.col("rid").alias("raw_id"), F.col("us").alias("utc_us"))
