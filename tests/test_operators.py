"""Operators on small literal inputs: stated results, nulls, empty inputs, ties, repeated rows, clashing names."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.functions import extract, scoring
from strataforge.functions import text as T
from strataforge.operators import aggregates, dedup, joins, validate, windows

UNIT = "unit_id long, repo int, theme string, summary string, section_name string, file_paths array<string>"
DIM = "repo int, name string, domain_id long, paths array<string>, keywords array<string>"


def one(df):
    (row,) = df.collect()
    return row


def val(spark, c, **kw):
    cols = ", ".join(f"{k} {t}" for k, (t, _) in kw.items())
    df = spark.createDataFrame([tuple(v for _, v in kw.values())], cols) if kw else spark.range(1)
    return one(df.select(c.alias("x"))).x


# ---- joins


def scored(spark, units, dims):
    return {r.unit_id: (r.name, r.score, r.second) for r in joins.scored_winner(spark.createDataFrame(units, UNIT), spark.createDataFrame(dims, DIM), ["repo"], "unit_id", "name").collect()}


def test_scored_winner(spark):
    dims = [(1, "auth", 1, ["src/auth/"], ["login", "token"]), (1, "billing", 2, ["src/pay/"], ["invoice"]), (2, "auth", 3, [""], None)]
    units = [
        (1, 1, "auth login", "auth token check, token token", "login", ["src/auth/a.py", "src/auth/b.py"]),  # 5+3+2+2+1
        (2, 1, None, None, None, None),
        (3, 1, "misc", "an invoice", "", []),  # 2+1: too little
        (4, 1, "auth invoice", "auth invoice", "", []),  # both score alike
        (5, 2, "auth", "auth", None, ["x"]),  # 5 in its own repository
        (6, None, "auth", "auth", "auth", ["src/auth/"]),
    ]
    got = scored(spark, units, dims)
    assert got[1] == ("auth", 13, 0)
    assert got[2] == (None, 0, 0)
    assert got[3][0] is None and got[3][1] == 3
    assert got[4][0] is None and got[4][1] - got[4][2] < 2
    assert got[5] == ("auth", 5, 0)
    assert got[6][0] is None
    assert scored(spark, [], dims) == {} and scored(spark, units[:1], [])[1] == (None, 0, 0)


def rows_out(plan) -> int:
    """The most rows that an operator of a plan that has run put out."""
    kind = plan.getClass().getSimpleName()
    under = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if "QueryStage" in kind else [plan.children().apply(i) for i in range(plan.children().size())]
    n = plan.metrics().get("numOutputRows")
    return max([n.get().value() if n.isDefined() else 0, *map(rows_out, under)])


def test_scored_winner_makes_no_pairs(spark):
    """Words and prefixes that all rows share: the work is that of the rows, not of their pairs."""
    dims = spark.createDataFrame([(1, f"shared word{i}", i, ["src/"], ["common"]) for i in range(400)], DIM)
    units = spark.createDataFrame([(i, 1, "shared", "common", "shared", ["src/a"]) for i in range(600)], UNIT)
    out = joins.scored_winner(units, dims, ["repo"], "unit_id", "name")
    assert {tuple(r)[1:] for r in out.collect()} == {(None, 13, 13)}
    assert rows_out(out._jdf.queryExecution().executedPlan()) <= 2 * (400 + 600)


def test_scored_winner_blocks(spark, monkeypatch):
    """Against brute force, in one block and in many; a dim in several rows, ties, odd texts and paths."""
    rng = random.Random(5)
    words = ["auth", "pay", "log_in", "Über", "a-b", "\u0130x", "cache", "q", "/", ""]
    some = lambda n: " ".join(rng.choices(words, k=rng.randint(0, n)))
    paths = ["src/", "src/a", "s", "\U0001f600/x", "\U0001f600", "src/a/b.py", "", None]
    dims = [(rng.randint(1, 2), some(2) or "n", i, rng.choice([None, rng.choices(paths, k=2)]), rng.choice([None, [some(1), None]])) for i in range(60)]
    units = [(i, rng.choice([1, 2, 3, None]), rng.choice([None, some(2)]), some(4), some(1), rng.choice([None, rng.choices(paths, k=2)])) for i in range(150)]

    def toks(x):
        import re

        return set(re.findall("[a-z0-9_]+", (x or "").lower().translate(str.maketrans("-_/", "   "))))

    want = {}
    for uid, repo, theme, summary, section, files in units:
        fields = [toks(theme), toks(summary), toks(section)]
        by = {}
        for r, name, _, pre, kws in dims:
            if r == repo:
                kw = set().union(*map(toks, kws or []))
                sig = toks(name) | kw
                has = [bool(sig & f) for f in fields] + [any(kw & f for f in fields), any(f.startswith(p) for f in files or [] if f for p in pre or [] if p)]
                by[name] = [a or b for a, b in zip(by.get(name, has), has)]
        top = sorted((-sum(p for p, h in zip((3, 2, 2, 1, 5), has) if h), name) for name, has in by.items()) + [(0, None), (0, None)]
        score, second = -top[0][0], -top[1][0]
        want[uid] = (top[0][1] if score >= 4 and score - second >= 2 else None, score, second)
    assert scored(spark, units, dims) == want and any(w[0] for w in want.values())
    monkeypatch.setattr(joins, "UNIT_BLOCK", 7)
    monkeypatch.setattr(joins, "DIM_BLOCK", 5)
    monkeypatch.setattr(joins, "SETS", 1)
    assert scored(spark, units, dims) == want


def test_prefix_winner(spark):
    dims = [(1, "general", 1, ["src/"], None), (1, "specific", 2, ["src/deep/"], None), (1, "late", 3, ["src/"], None), (1, "none", 4, ["", None], None)]
    units = [
        (1, 1, "", "", "", ["src/deep/x.py"]), (2, 1, "", "", "", ["src/deep/x.py", "src/y.py"]), (3, 1, "", "", "", ["src/deep/x.py", "docs/a"]),
        (4, 1, "", "", "", ["src/a", "src/a", None, ""]), (5, 1, "", "", "", None), (6, 2, "", "", "", ["src/a"]),
    ]
    f = joins.prefix_winner(spark.createDataFrame(units, UNIT), spark.createDataFrame(dims, DIM), ["repo"], "unit_id", "file_paths", "name", "paths", "domain_id")
    assert {r.unit_id: r.name for r in f.collect()} == {1: "specific", 2: None, 3: "specific", 4: "general", 5: None, 6: None}


def test_fuzzy_pairs_brute(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    rows = [(1, rng.choice(["test", "tests", "ax", " AX ", "", None, f"n{i}"]), i, rng.sample(words, rng.randint(0, 4)) if rng.random() < 0.9 else None, rng.sample(words, rng.randint(0, 5))) for i in range(80)]
    got = {tuple(r) for r in joins.fuzzy_pairs(spark.createDataFrame(rows, DIM), ["repo"], "domain_id", "name", "keywords", "paths").collect()}
    reps = {}
    for _, n, i, p, k in rows:
        n = (n or "").strip().lower()
        if n:
            reps.setdefault((n, tuple(sorted(set(k or []))), tuple(sorted(set(p or [])))), i)
    items = [(i, n, set(k), set(p)) for (n, k, p), i in reps.items()]
    want = set()
    for a in items:
        for b in items:
            if a[0] < b[0]:
                kw, pa = a[2] & b[2], a[3] & b[3]
                if a[1] == b[1] or a[1] + "s" == b[1] or b[1] + "s" == a[1] or (len(kw) >= 2 and 2 * len(kw) >= min(len(a[2]), len(b[2]))) or (a[3] and b[3] and 5 * len(pa) >= 3 * min(len(a[3]), len(b[3]))):
                    want.add((a[0], b[0]))
    assert got == want and got


def test_record_classes_brute(spark):
    """Copies are rows too, with all their links."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(9)]
    rows = [(1, rng.choice(["test", "tests", "ax", "", None, f"n{i}"]), i, rng.sample(words, rng.randint(0, 4)) if rng.random() < 0.9 else None, rng.sample(words, rng.randint(0, 5))) for i in range(60)]
    rows += [(1, f" {(n or '').upper()} ", 100 + i, (p or []) + [""], (k or [])[::-1]) for _, n, i, p, k in rows[:30]] + [(None, "alone", i, ["w1"], ["w1", "w2"]) for i in (200, 201)] + [(2, "copy", i, ["x"], []) for i in (300, 301, 302)]
    got = {r.domain_id: (r.class_id, r.n_links) for r in joins.record_classes(spark.createDataFrame(rows, DIM), ["repo"], "domain_id", "name", "keywords", "paths").collect()}
    items = [(i, r, (n or "").strip().lower(), set(k or []), set(p or []) - {""}) for r, n, i, p, k in rows if (n or "").strip()]
    want = {}
    for i, r, n, k, p in items:
        links, same = 0, [i]
        for j, s, m, l, q in items:
            if i != j and r is not None and r == s:
                kw, pa = k & l, p & q
                links += n == m or n + "s" == m or m + "s" == n or (len(kw) >= 2 and 2 * len(kw) >= min(len(k), len(l))) or bool(p and q and 5 * len(pa) >= 3 * min(len(p), len(q)))
                same += [j] * ((n, k, p) == (m, l, q))
        want[i] = (min(same), links)
    assert got == want and got[302] == (300, 2) and got[201] == (201, 0) and len({c for c, _ in got.values()}) < len(got)


def test_phrase_ranks(spark):
    docs = spark.createDataFrame([(1, "The Service-Registry backend must stay"), (2, ""), (3, None), (4, "nothing here")], "id long, t string")
    r = joins.phrase_ranks(docs, "id", "t", [("redis_discovery", ["service registry backend"]), ("service", []), ("must stay", [])]).collect()
    got = {(x.id, x.candidate): (x.score, x.rank) for x in r}
    assert got == {(1, "must stay"): (162, 1), (1, "service"): (101, 2), (1, "redis_discovery"): (60, 3)}


def test_snapshots_and_caches(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "k string, d string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("n", "1"), ("z", None)], "k string, d string")
    assert {r.k: r.status for r in joins.snapshot_diff(a, b, "k", "d").collect()} == {"x": "unchanged", "y": "changed", "n": "added", "z": "unchanged"}
    now = datetime.datetime(2024, 1, 2)
    cache = spark.createDataFrame([("x", "1", now - datetime.timedelta(hours=5)), ("y", "3", now - datetime.timedelta(hours=50)), ("n", "1", None)], "k string, d string, at timestamp")
    hit = {r.k: r.hit for r in joins.cache_lookup(b, cache, "k", "d", "at", F.lit(now), 24).collect()}
    assert hit == {"x": True, "y": False, "n": True, "z": False}
    assert {r.hit for r in joins.cache_lookup(b, cache, "k", "d", "at", F.lit(now), 0).filter("k = 'y'").collect()} == {True}
    assert {(r.k, r.problem) for r in joins.consistency(a, spark.createDataFrame([("x", True), ("q", True), ("y", False)], "k string, ok boolean"), "k", "ok").collect()} == {("q", "orphaned"), ("y", "corrupt"), ("z", "missing")}
    assert joins.unseen(b, a, ["k"]).collect()[0].k == "n"
    dec = spark.createDataFrame([("verify_first",)], "a string")
    none = spark.createDataFrame([], "s string")
    assert one(joins.blocked(dec, none, "a", "s")).blocked and not one(joins.blocked(dec, spark.createDataFrame([("done",)], "s string"), "a", "s")).blocked
    assert not one(joins.blocked(dec.filter("a = 'x'"), none, "a", "s")).blocked
    assert val(spark, joins.same_fingerprint([F.lit(None), F.lit("a")], [F.lit(None), F.lit("a")]))


# ---- distinct and merged


def test_wins(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "q")], "o long, k string, v string")
    assert {r.o: r.kept for r in dedup.first_wins(rows, ["k"], "o").collect()} == {1: True, 2: False, 3: True, 4: False}
    assert [(r.k, r.v) for r in dedup.last_wins(rows, ["k"], ["o"]).collect()] == [("a", "y")]
    assert dedup.first_wins(rows.limit(0), ["k"], "o").count() == 0


def test_distinct_arrays(spark):
    arr = F.array(F.lit("b "), F.lit("a"), F.lit(None), F.lit("B"), F.lit(""), F.lit("a"))
    assert val(spark, dedup.sorted_distinct(arr)) == ["B", "a", "b "]
    assert val(spark, dedup.ordered_distinct(arr)) == ["b", "a", "B"]
    assert val(spark, dedup.ordered_distinct_ci(arr)) == ["b", "a"]
    assert val(spark, dedup.missing(["a", "z"], arr)) == ["z"]
    empty = F.array().cast("array<string>")
    assert val(spark, dedup.overlap_smaller(empty, arr)) == 0.0 and val(spark, dedup.overlap_larger(arr, F.array(F.lit("a")))) == pytest.approx(1 / 6)


def test_greedy_merge(spark):
    rows = [(1, 1, "test", "", ["a"], ["k1"]), (1, 2, "tests", "d", ["b"], ["k2"]), (1, 3, "misc", "x", ["a"], None), (1, 4, "other name", "", ["a", "c"], []), (1, 5, "solo", None, None, ["k9"]), (2, 6, "test", "t", [], []), (1, 7, " ", "", [], [])]
    df = spark.createDataFrame(rows, "k long, o long, name string, description string, paths array<string>, keywords array<string>")
    got = {(r.k, r.no): (r.name, r.description, r.paths, r.keywords, r.members) for r in dedup.merge_records(df, "k", "o", "name").collect()}
    assert got == {
        (1, 0): ("tests", "d", ["a", "b"], ["k1", "k2"], 2), (1, 1): ("other name", "", ["a", "c"], [], 1), (1, 2): ("solo", "", [], ["k9"], 1), (2, 0): ("test", "t", [], [], 1),
    }


def test_cases_and_similarity(spark):
    df = spark.createDataFrame([("m", "low", "x" * 18, 1), ("m", "high", "y" * 30, 2), ("m", "high", "z" * 20, 3), ("m", "high", "w" * 16, 4)], "m string, v string, t string, id long")
    r = one(dedup.canonical_case(df, ["m"], "v", "t", "id"))
    assert (r.id, r.cases) == (3, 4)
    s = dedup.similarity(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")), F.lit("abcd"), F.lit("bcde"), F.array(F.lit("x")), F.array(F.lit("x")))
    assert val(spark, s) == pytest.approx(0.5 * 0.75 + 0.3 * 0.5 + 0.2)


# ---- order


def fold(ws, budget=3000, most=15):
    out, cur, w, b = [], [], 0, -1
    for x in ws:
        if x > budget:
            b += 1
            out.append(b)
            cur = []
            w = None
            continue
        if w is None or not cur or w + x > budget or len(cur) >= most:
            b, cur, w = b + 1, [x], x
        else:
            cur.append(x)
            w += x
        out.append(b)
    return out


@pytest.mark.parametrize("ws", [[1000, 1000, 1000, 500], [1] * 20, [10, 4000, 10], [5000], [3000, 1], [0] * 16, []])
def test_batches(spark, ws):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(ws)], "k int, o long, w long")
    assert [r.batch for r in windows.batches(df, ["k"], "o", "w").orderBy("o").collect()] == fold(ws)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 3500), max_size=60))
def test_batches_keep_every_row_in_order(spark, ws):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(ws)], "k int, o long, w long")
    assert [r.batch for r in windows.batches(df, ["k"], "o", "w").orderBy("o").collect()] == fold(ws)


def test_versions(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 0, "y"), ("a", 10, 7, "bad"), ("b", 1, 0, "z")], "n string, v int, size long, c string")
    assert [(r.n, r.v) for r in windows.latest_version(df, ["n"], "v", "size").collect()] == [("a", 10)]
    assert [(r.n, r.v) for r in windows.latest_version(df, ["n"], "v", "size", F.col("c") != "bad").collect()] == [("a", 1)]
    many = spark.createDataFrame([("a", i) for i in range(1, 7)], "n string, v int")
    assert sorted(r.v for r in windows.retained(many, ["n"], "v", F.col("v") == 1).filter("keep").collect()) == [1, 4, 5, 6]
    cache = spark.createDataFrame([(i, None if i == 3 else datetime.datetime(2024, 1, 1 + i % 2)) for i in range(5)], "k long, at timestamp")
    assert sorted(r.k for r in windows.evicted(cache, "k", "at", 2).collect()) == [0, 2, 3]
    assert windows.evicted(cache, "k", "at", 0).count() == 0 and windows.evicted(cache, "k", "at", 9).count() == 0
    assert val(spark, windows.next_stage(["a", "b"], F.array(F.lit("a")))) == "b"
    f = spark.createDataFrame([("x.v2.md",), ("x.v10.md",), ("y.md",)], "p string")
    assert one(aggregates.versions(f, "p")).versions == [2, 10]


def test_arbitration(spark):
    df = spark.createDataFrame([(1, "k", "a b c d", 2), (2, "k", "a b c e", 0), (3, "k", "q r s", 1), (4, "m", None, 0)], "id long, k string, s string, r int")
    got = {r.id: (r.winner_id, r.outcome) for r in windows.arbitrated(df, ["k"], "id", "s", [F.col("r")]).collect()}
    assert got == {1: (2, "dropped"), 2: (2, "winner"), 3: (2, "kept"), 4: (4, "winner")}


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n## A\nx\ny\n## B\n"), (2, "none"), (3, None), (4, ""), (5, "## A\r\nb\r\n## A\r\nc")], "id long, t string")
    got = sorted((r.id, r.section_no, r.title, r.n_lines) for r in windows.sections(df, "id", "t").collect())
    assert got == [(1, 0, "", 1), (1, 1, "A", 2), (1, 2, "B", 1), (2, 0, "", 1), (4, 0, "", 1), (5, 0, "", 0), (5, 1, "A", 1), (5, 2, "A", 1)]
    assert [(r.title, r.content) for r in windows.section_bodies(df.filter("id = 1"), "id", "t").orderBy("section_no").collect()] == [("intro", "intro"), ("A", "x\ny"), ("B", "")]
    text = F.lit("x\nConcepts:\n\n - a\n* A\n- b\nnext: 1\n- c")
    assert val(spark, windows.bullets_after(text, "concepts")) == ["a", "b"] and val(spark, windows.bullets_after(F.lit("y"), "z")) == []
    low = spark.createDataFrame([(1, "Pipe\nConfidence: LOW"), (2, "confidence: low"), (3, None)], "id long, t string")
    assert {(r.id, r.context) for r in windows.low_confidence(low, "id", "t").collect()} == {(1, "Pipe"), (2, "confidence: low")}


# ---- checks, scalars, extraction


def test_checks(spark):
    good = spark.createDataFrame([("c", "t", "s", "feat", "primary", ["a"]), (None, " ", None, "FEAT", None, [])], "commit_id string, theme string, summary string, op string, importance string, file_paths array<string>")
    errs = [r.e for r in good.select(validate.unit_errors().alias("e")).collect()]
    assert errs[0] == [] and errs[1] == ["missing commit_id", "missing theme", "missing summary", "invalid op: FEAT", "invalid importance: null", "no file_paths"]
    t = F.lit("## Modules\n## pipelinesX\n## Re.po s")
    assert val(spark, validate.missing_headings(t, ("modules", "Pipelines", "Re.po"))) == ["Pipelines"]
    assert val(spark, validate.missing_headings(F.lit(None).cast("string"), ("A",))) == ["A"] and not val(spark, validate.any_heading(t, ("X",)))
    assert val(spark, validate.acceptance(F.lit("x\n  Acceptance: TRUE "))) and not val(spark, validate.acceptance(F.lit(None).cast("string")))
    assert val(spark, validate.unknown_fields(F.lit('{"a":1,"z":2}'), ["a"])) == ["z"]
    assert val(spark, validate.stable(F.lit("i"), F.array(F.lit("r")), F.lit("high"))) is False and val(spark, validate.stable(F.lit("i"), F.array(F.lit("r")), F.lit("low"))) is True
    assert val(spark, validate.consistent_scores(F.lit(5.0), F.lit(5.0), F.lit(11.0))) == ["priority must be the largest score", "score out of range"]


def test_texts(spark):
    n = lambda s, **k: val(spark, T.normalise_text(F.lit(s), **k))
    assert n("  修正  BUG，在  123  个文件中  ", numbers=True) == "修复 bug,在 <NUM> 个文件中"
    assert n("version 1.2.3", numbers=True) == "version <NUM>.<NUM>" and n("ｈｅｌｌｏ") == "hello" and n("   ") == "" and n("É。") == "É."
    assert val(spark, T.normalise_text(F.lit(None).cast("string"))) is None
    assert val(spark, T.tokens(F.lit("A-b a_1 A"))) == ["a", "b", "a_1"] and val(spark, T.signal_tokens(F.lit("a_b/C-d"))) == ["a", "b", "c", "d"]
    assert val(spark, T.contains_phrase(F.lit("the service-registry layer"), F.lit("Service registry"))) and not val(spark, T.contains_phrase(F.lit("x"), F.lit("--")))


@pytest.mark.parametrize(
    ("stat", "weight"),
    [(" 3 files changed, 100 insertions(+), 50 deletions(-)", 150), (" 1 file changed, 10 insertions(+)", 10), (" 2 files changed, 30 deletions(-)", 30), (" a | Bin 0 -> 99 bytes\n", 500),
     (" a | Bin 0 -> 9 bytes\n 2 files changed, 8 insertions(+)", 508), ("", 0), ("Bin 1 -> 2 bytes Bin 3 -> 4 bytes", 1000)],
)
def test_stat_weight(spark, stat, weight):
    assert val(spark, scoring.stat_weight(F.lit(stat))) == weight


def test_labels(spark):
    d = lambda s: (val(spark, scoring.development_type(F.lit(s))), val(spark, scoring.open_question(F.lit(s))))
    assert d("Fix and optimize parser performance") == ("bugfix", "Multiple development intents detected (bugfix, optimize); confirm primary type is 'bugfix'.")
    assert d("Add an option") == ("feature", None) and d("prefix")[0] == "feature" and d("prefix")[1].startswith("Issue intent is unclear")
    i = lambda s: val(spark, scoring.intent(F.lit(s)))
    assert [i("Check it"), i("start over"), i("next"), i("go on"), i("do"), i("")] == ["status", "reset", "step", "resume", "run", "run"]
    assert val(spark, scoring.stable_id("domain", F.lit("auth"), "rec_")) == "rec_domain_" + __import__("hashlib").sha256(b"domain:auth").hexdigest()[:12]
    b, v = scoring.scores(F.lit("high"), F.lit(9), F.lit(1))
    assert (val(spark, b), val(spark, v)) == (10.0, 8.3)
    rec = [val(spark, scoring.recommended(F.lit(x), F.lit(p))) for x, p in (("fail", 9.0), ("pass", 8.0), ("pass", 6.0), ("pass", 4.0))]
    assert rec == ["drop", "keep", "verify_first", "backlog"]
    assert [val(spark, scoring.human_size(F.lit(n))) for n in (5, 2048, 3 * 1024**2)] == ["5 B", "2.0 KB", "3.0 MB"]
    assert val(spark, scoring.month_of(F.lit("2024"))) == "unknown" and val(spark, scoring.module_of(F.lit("a/b"))) == "a"


def test_extraction(spark):
    assert val(spark, extract.without_fences(F.lit("```json\n[1]\n```"))) == "[1]" and val(spark, extract.without_fences(F.lit("a ```"))) == "a ```"
    arr = val(spark, extract.json_objects(F.lit('```\n[{"id": "a"}, {"x": 1}, null]\n```'), "struct<id: string>", ["id"]))
    assert [x.id for x in arr] == ["a"] and val(spark, extract.json_objects(F.lit("{cut"), "struct<id: string>", ["id"])) in (None, [])
    p = F.lit('{"shared_hints": {"aliases": [{"domain": " c ", "name": "a"}, {"alias": "b"}, {"canonical": "x", "alias": "y", "kind": ""}]}}')
    assert [tuple(x) for x in val(spark, extract.aliases(p))] == [("c", "a", "term"), ("x", "y", "term")]
    diff = F.lit("diff --git a/x b/x\n+++ b/x\n+one\n-two\ndiff --git a/y b/z\n-gone")
    assert val(spark, F.transform(extract.diff_chunks(diff), extract.chunk_path)) == ["x", "z"]
    assert val(spark, extract.added_lines(diff)) == 1 and val(spark, extract.removed_lines(diff)) == 2
    assert val(spark, extract.labelled(F.lit("- Kind: a \nkind : A\nKIND: b"), "kind")) == ["a", "b"]
    t = F.lit("`Foo` and class Bar: def baz(): see `src/a_b.py` or tests/x.py, key `max_size`, `Foo`")
    assert val(spark, extract.named(t, "symbol")) == ["Foo", "Bar", "baz"] and val(spark, extract.named(t, "config_key")) == ["max_size"] and val(spark, extract.named(t, "file_path")) == ["src/a_b.py", "tests/x.py"]
    code = "class A:\n  def m(self): pass\n  def _p(self): pass\nasync def f(): pass\ndef _g(): pass\n"
    src = spark.createDataFrame([("a.py", code), ("b.py", "def ("), ("c.py", None)], "p string, s string")
    tab = extract.symbol_table(src, "p", "s")
    assert {(r.kind, r.name) for r in tab.collect()} == {("class", "A"), ("method", "A.m"), ("function", "f")}
    assert tuple(one(extract.symbol_summary(tab, "p"))) == ("a.py", 1, ["A"], 1)


def test_aggregates(spark):
    rows = spark.createDataFrame([(1, ["a/x", "b", "a/x"]), (2, ["b", None]), (3, None)], "o long, f array<string>")
    assert [(r.module, r.touches, r.rank) for r in aggregates.top_modules(rows, "o", "f").collect()] == [("a", 2, 1), ("root", 2, 2)]
    u = spark.createDataFrame([(1, "t", ""), (2, "t", "s"), (3, "q", None), (4, None, "z")], "o long, th string, s string")
    assert [(r.grp, r.s) for r in aggregates.representatives(u, F.col("th"), "s", "o").collect()] == [("t", "s"), (None, "z")]
    none = aggregates.health(u.limit(0), F.lit(True), F.lit(True), F.lit(True), F.lit(True), F.lit(True))
    assert tuple(one(none)) == (0, 0, 0.0, 0.0, 0.0, 0)
    assert [val(spark, aggregates.adjudicated(F.lit(n), F.lit(c))) for n, c in ((2, ""), (1, ""), (0, "It SHALL"), (0, "x"))] == ["evidence_backed", "weakly_backed", "drift", "gap"]
