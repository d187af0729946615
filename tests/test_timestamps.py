"""Timestamps against an independent reading with datetime and zoneinfo, and Viterbi against all paths."""

import itertools
import os
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataforge.operators import timestamps as T

EPOCH = datetime(1970, 1, 1)
LOW, HIGH = datetime(2000, 1, 1), datetime(2030, 1, 1)
DE = dict(zip("januar februar märz april mai juni juli august september oktober november dezember".split(), range(1, 13)))
ABBR = {"UTC": 0, "GMT": 0, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7}
NAIVE = ["%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y/%m/%d %H:%M:%S", "%a %b %d %H:%M:%S %Y", "%Y-%m-%dT%H:%M:%S", "%Y%m%d %H%M%S",
         "%b %d, %Y %I:%M:%S %p", "%Y年%m月%d日 %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S,%f", "%Y-%m-%dT%H:%M:%S,%f"]
AWARE = ["%Y-%m-%d %H:%M:%S %z", "%Y-%m-%dT%H:%M:%S%z", "%a %b %d %H:%M:%S %Y %z", "%a, %d %b %Y %H:%M:%S %z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y%m%dT%H%M%S%z",
         "%G-W%V-%uT%H:%M:%S%z", "%Y-%jT%H:%M:%S%z"]
ENDS = ["%H:%M:%S", "%H:%M", "%I:%M:%S %p", "%I:%M %p"]


def us(d):
    return (d - EPOCH) // timedelta(microseconds=1)


def wall(d, tz):
    if not tz:
        return None
    a = d.replace(tzinfo=ZoneInfo(tz), fold=0)
    return (d - a.utcoffset())


def expected(s, tz, order):
    if s is None:
        return None
    t = s.strip().strip('"').strip().replace("−", "-")
    m = re.fullmatch(r"([+-]?\d+(?:\.\d+)?(?:E\d+)?)(?: [+-]\d{4})?", t)
    out = None
    if m:
        from decimal import Decimal

        v = Decimal(m[1])
        for k in (10**6, 10**3, 1, Decimal(1) / 1000):
            x = int(v * k)
            if us(LOW) <= x < us(HIGH):
                return x
        return None
    t = re.sub(r"\[.*\]$", "", t)
    t = re.sub(r"(\.\d{6})\d+", r"\1", t)
    t = re.sub(r"([T ]\d\d:\d\d:\d\d(?:\.\d+)?)([+-]\d\d)$", r"\1\g<2>00", t)
    if t.endswith("z"):
        t = t[:-1] + "Z"
    m = re.fullmatch(r"(.*) ([A-Za-z]{3,4})", t)
    if m and m[2].upper() in ABBR:
        try:
            out = datetime.strptime(m[1], NAIVE[0]) - timedelta(hours=ABBR[m[2].upper()])
        except ValueError:
            return None
    m = re.fullmatch(r"(\d+)\. (\w+) (\d{4}) (.*)", t)
    if m and m[2].lower() in DE:
        t = f"{m[3]}-{DE[m[2].lower()]:02d}-{int(m[1]):02d} {m[4]}"
    m = re.fullmatch(r"(\d+)([./-])(\d+)\2(\d{4}) (.*)", t)
    if m:
        day, month = (m[1], m[3]) if order == "dmy" else (m[3], m[1])
        for f in ENDS:
            try:
                return (lambda d: d and (us(d) if LOW <= d < HIGH else None))(wall(datetime.strptime(f"{m[4]}-{month}-{day} {m[5]}", "%Y-%m-%d " + f), tz))
            except ValueError:
                pass
        return None
    for f in NAIVE if out is None else []:
        try:
            out = wall(datetime.strptime(t, f), tz)
            break
        except ValueError:
            pass
    for f in AWARE if out is None else []:
        try:
            out = datetime.strptime(t, f).astimezone(timezone.utc).replace(tzinfo=None)
            break
        except ValueError:
            pass
    return us(out) if out is not None and LOW <= out < HIGH else None


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_against_datetime(spark, sf):
    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    commits, repos = spark.read.parquet(f"{d}/raw_commits.parquet"), spark.read.parquet(f"{d}/repos.parquet")
    got = {r.raw_id: r.utc_us for r in T.commit_instants(commits, repos, size=300).collect()}
    rows = commits.join(repos, "repo_id", "left").select("raw_id", "commit_timestamp", "tz_name", "date_order").collect()
    want = {r.raw_id: x for r in rows if (x := expected(r.commit_timestamp, r.tz_name, r.date_order)) is not None}
    texts = {r.raw_id: (r.commit_timestamp, r.tz_name, r.date_order) for r in rows}
    differ = [(texts[k], got.get(k), want.get(k)) for k in set(got) | set(want) if got.get(k) != want.get(k)]
    assert not differ, (len(differ), differ[:5])


def brute_instants(con):
    """p2_found of a connection's tables; every repository of them states its date order."""
    rows = con.execute("select raw_id, commit_timestamp, tz_name, date_order from raw_commits left join repos using (repo_id)").fetchall()
    return [{"raw_id": i, "utc_us": x} for i, t, tz, o in rows if (x := expected(t, tz, o)) is not None]


CASES = [
    ("2021-03-28 02:30:00", "Europe/Berlin", "dmy", "2021-03-28 01:30:00"),  # skipped: the offset before the change
    ("2021-10-31 02:30:00", "Europe/Berlin", "dmy", "2021-10-31 00:30:00"),  # twice: the first
    ("05/04/2021 10:00", "UTC", "dmy", "2021-04-05 10:00:00"),
    ("05/04/2021 10:00", "UTC", "mdy", "2021-05-04 10:00:00"),
    ("31/12/2021 10:00", "UTC", "mdy", None),
    ("12/31/2021 12:05 am", "UTC", "mdy", "2021-12-31 00:05:00"),
    (" '1700000000123456789 +0200' ", None, "dmy", "2023-11-14 22:13:20.123456"),
    ("2021-02-30 10:00:00", "UTC", "dmy", None),
    ("2020-W53-5T00:00:00Z", None, None, "2021-01-01 00:00:00"),
    ("2021-W53-5T00:00:00Z", None, None, None),
    ("2020-366T00:00:00Z", None, None, "2020-12-31 00:00:00"),
    ("2021-366T00:00:00Z", None, None, None),
    ("2021-01-01 10:00:00", None, "dmy", None),
    ("2021-01-01 10:00:00 XYZ", "UTC", "dmy", None),
    ("2021-01-01", "UTC", "dmy", None),
    ("2029-12-31T23:30:00-01:00", "UTC", "dmy", None),
    ("", "UTC", "dmy", None),
    (None, "UTC", "dmy", None),
    ("x" * 100_000, "UTC", "dmy", None),
]


def test_cases(spark):
    rows = [(i, i % 3 if i % 4 else None, s, tz, o, None) for i, (s, tz, o, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "rid long, src long, t string, tz string, o string, at timestamp")
    got = {r.rid: r.us for r in T.resolve(T.interpretations(df, "t", "tz", "o"), "rid", "src", "at").collect()}
    for i, (s, _, _, want) in enumerate(CASES):
        assert got.get(i) == (None if want is None else us(datetime.fromisoformat(want))), (s, got.get(i))


def test_empty(spark):
    df = spark.createDataFrame([], "rid long, src long, t string, tz string, o string, at timestamp")
    assert T.resolve(T.interpretations(df, "t", "tz", "o"), "rid", "src", "at").count() == 0


@pytest.mark.parametrize("size", [1, 2, 100])
def test_viterbi_is_the_cheapest_path(spark, size):
    """Without a stated order the neighbours decide; chunks of any size give the cost of the best of all paths."""
    texts = ["03/02/2021 10:00", "04/02/2021 10:00", "15/02/2021 10:00", "03/03/2021 09:00", "2021-03-05 10:00:00", "04/06/2021 10:00", "05/06/2021 10:00", "01/07/2021 10:00"]
    rows = [(i, 1, t, "UTC", None, datetime(2021, 2, 1) + timedelta(hours=2 * i)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "rid long, src long, t string, tz string, o string, at timestamp")
    read = T.interpretations(df, "t", "tz", "o")
    options = [[(r["fmt"], r["us"], r["cost"]) for r in x.readings] for x in read.orderBy("rid").collect()]

    def cost(path):
        c = sum(p[2] for p in path)
        for p, q in zip(path, path[1:]):
            c += T.SWITCH * (p[0] != q[0]) + T.BACKWARD * (q[1] < p[1] - T.SLACK_US)
        return c

    best = min(cost(p) for p in itertools.product(*options))
    got = {r.rid: r.us for r in T.resolve(read, "rid", "src", "at", size).collect()}
    path = [next(o for o in options[i] if o[1] == got[i]) for i in range(len(texts))]
    assert cost(path) == best
    assert got[0] == us(datetime(2021, 2, 3, 10)) and got[7] == us(datetime(2021, 7, 1, 10))


def test_neighbours_decide_what_no_row_can(spark):
    """Equal texts mean different days: once by what stands beside them, once by the source's habit; neither is in the row."""
    def source(n, *texts):
        return [(100 * n + i, n, t, "UTC", None, datetime(2021, 2, 1) + timedelta(days=i)) for i, t in enumerate(texts)]

    same = "03/04/2021 10:00"
    rows = source(1, "28/03/2021 10:00", same, "05/04/2021 10:00") + source(2, "2021-03-03 10:00", same, "2021-03-05 10:00") + source(3, "02/28/2021 10:00", "2021-02-28 11:00", same, "2021-04-03 10:00")
    rows += source(4, *["13/05/2021 10:00"] * 3, "2021-05-14 10:00", same, "2021-05-14 11:00")  # the habit says 3 April, which is a step back; so is 4 March
    df = spark.createDataFrame(rows, "rid long, src long, t string, tz string, o string, at timestamp")
    read = T.with_habits(T.interpretations(df, "t", "tz", "o"), "src")
    got = {r.rid: r.us for r in T.resolve(read, "rid", "src", "at").collect()}
    april, march = us(datetime(2021, 4, 3, 10)), us(datetime(2021, 3, 4, 10))
    assert got[101] == april and got[201] == march and got[302] == march and got[404] == april
    path = T.resolve(T.interpretations(df, "t", "tz", "o"), "rid", "src", "at").filter("rid = 201").first().us
    assert path == march  # without a habit too: the first reading listed is 3 April


def test_chunks_of_one_instant(spark):
    """Records of one hour, of one instant and without a time are cut too; order and result stay."""
    rows = [(i, i % 2, "0%d/05/2021 10:00" % (1 + i % 9), "UTC", None, None if i < 60 else datetime(2021, 5, 1, 10, 0, i % 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "rid long, src long, t string, tz string, o string, at timestamp")
    read = T.interpretations(df, "t", "tz", "o")
    whole = {r.rid: r.us for r in T.resolve(read, "rid", "src", "at", 10_000).collect()}
    assert whole == {r.rid: r.us for r in T.resolve(read, "rid", "src", "at", 7).collect()} and len(whole) == 150
    flat = df.select("rid", F.col("src").alias("source"), F.coalesce(F.unix_micros("at"), F.lit(0)).alias("at"))
    sizes = T.chunked(flat, 7).groupBy("source", "chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 14 and len(sizes) >= 20
