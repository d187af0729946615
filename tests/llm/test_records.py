"""Set joins, survivors and the mapping to a list, against brute force and on edge cases."""

import datetime
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.llm import canon, setjoin, survivors

SETS = "field string, id long, toks array<string>"


def brute_pairs(rows):
    out = set()
    for f, i, a in rows:
        for g, j, b in rows:
            if f == g and i < j and a and b and Fraction(len({*a} & {*b}), len({*a} | {*b})) >= Fraction(3, 5):
                out.add((f, i, j))
    return out


def made(rows):
    return [(f, i, sorted(set(t))) for f, i, t in rows]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(0, 8), max_size=7), max_size=40))
def test_pairs_against_brute_force(spark, sets):
    rows = made([("k" if i % 4 else "p", i, [f"t{x}" for x in s]) for i, s in enumerate(sets)])
    got = [tuple(r) for r in setjoin.similar_pairs(spark.createDataFrame(rows, SETS)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


@pytest.mark.parametrize("hot", [1, 20_000])
def test_hot_sets_and_tokens(spark, hot, monkeypatch):
    """A third of the rows have one set, most sets share one token; split or not, the result is the same."""
    monkeypatch.setattr(setjoin, "HOT", hot)
    monkeypatch.setattr(setjoin, "PART", max(7, hot // 20))
    rng = random.Random(1)
    rows = made([("k", i, ["hot"] if i % 3 == 0 else ["hot", *(f"t{rng.randint(0, 9)}" for _ in range(rng.randint(1, 5)))]) for i in range(120)])
    df = spark.createDataFrame(rows, SETS)
    want = brute_pairs(rows)
    assert {tuple(r) for r in setjoin.similar_pairs(df).collect()} == want
    links = {r.id: (r.class_id, r.n_links) for r in setjoin.linked_records(df).collect()}
    for _, i, t in rows:
        assert links[i] == (min(j for _, j, u in rows if u == t), sum(1 for _, a, b in want if i in (a, b)))


def test_pairs_between_tables(spark):
    rng = random.Random(3)
    sets = [[f"t{rng.randint(0, 9)}" for _ in range(rng.randint(0, 6))] for _ in range(80)]
    rows = made([("k", i % 40, s) for i, s in enumerate(sets)])  # the same ids on both sides
    left, right = rows[:40], rows[40:]
    want = {(i, j) for _, i, a in left for _, j, b in right if a and b and Fraction(len({*a} & {*b}), len({*a} | {*b})) >= Fraction(3, 5)}
    got = [(r.id_a, r.id_b) for r in setjoin.similar_between(spark.createDataFrame(left, SETS), spark.createDataFrame(right, SETS)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert setjoin.similar_between(spark.createDataFrame(left, SETS), spark.createDataFrame([], SETS)).count() == 0


def test_sets_of_a_table(spark):
    rows = [
        (1, [" A", "a ", None, ""], ["./src\\x/", "src/x", " "]), (2, ["a"], ["src/x//"]), (3, None, []), (4, [], None), (5, ["a", "b", "c", "d", "e"], ["./"]),
        (6, ["a", "b", "c"], ["/"]), (6, ["a", "b", "c"], ["/"]), (None, ["a"], None),
    ]
    df = spark.createDataFrame(rows, "domain_id long, keywords array<string>, paths array<string>").withColumn("id", F.lit("clash")).withColumn("tok", F.lit(1))
    got = {tuple(r) for r in setjoin.similar_pairs(setjoin.domain_sets(df)).collect()}
    assert got == {("keywords", 1, 2), ("paths", 1, 2), ("keywords", 5, 6)}  # 3 of 5 counts
    assert setjoin.similar_pairs(setjoin.domain_sets(df.limit(0))).count() == 0


DOM = "domain_id long, repo_id long, domain_name string, description string, paths array<string>, keywords array<string>, source string, seen_at timestamp"
TRUST = [("architect", 0), ("import", 9), (None, 1)]
T = datetime.datetime


def test_survivors(spark):
    rows = [
        (1, 1, "Auth Flows", " ", ["a", "./a/", "b"], [""], "architect", None),
        (2, 1, "auth_flow", "old", ["a", "b", "c"], ["k"], "import", T(2020, 1, 1)),
        (3, 1, "AUTH-FLOW", "new", None, ["m"], "import", T(2021, 1, 1)),
        (4, 1, "authflows", "odd", [None], None, "nobody", T(2022, 1, 1)),
        (5, 2, "authflow", "x", ["z"], ["z"], "import", None),  # alone in its repository
        (6, 1, " ", "x", ["z"], ["z"], "import", None), (7, 1, "", "x", ["z"], ["z"], "import", None), (8, 1, None, "x", None, None, None, None),  # blank
        (9, 3, "b", None, [], [], None, None), (10, 3, "B", None, [], [], None, None),  # nothing to survive
        (11, None, "c", "x", [], [], None, None), (12, None, "c", "x", [], [], None, None),
        (13, 4, "d", "t", ["p"], ["q"], "import", T(2020, 1, 1)), (14, 4, "d", "t", ["p"], ["q"], "import", T(2020, 1, 1)),  # a tie
    ]
    df, trust = spark.createDataFrame(rows, DOM).withColumn("trust_rank", F.lit(5)), spark.createDataFrame(TRUST, "source string, trust_rank int")
    got = {tuple(r) for r in survivors.survivors(df, trust).collect()}
    assert got == {(1, "description", 3), (1, "keywords", 3), (1, "paths", 2), (13, "description", 13), (13, "keywords", 13), (13, "paths", 13)}
    rec = {r.group_id: r for r in survivors.surviving_records(df, trust).collect()}
    assert (rec[1].description, rec[1].keywords, rec[1].paths) == ("new", ["m"], ["a", "b", "c"])
    assert survivors.survivors(df.limit(0), trust).count() == 0


def test_currency(spark):
    at = lambda d: T(2020, 1, d)
    rows = [(i, i, "x", None, None, None, s, t) for i in range(1, 6) for s, t in (("draft", at(1)), ("final", at(2)))]
    rows = [(k, *r[1:]) for k, r in enumerate(rows, 1)]
    rows += [(100, 50, "y", None, None, None, "draft", at(9)), (101, 50, "y", None, None, None, "final", None), (102, 50, "y", None, None, None, "odd", None)]
    df = spark.createDataFrame(rows, DOM)
    moves = {(r.v, r.w): r.n for r in survivors.transitions(df, ["repo_id"], "source", "seen_at").collect()}
    assert moves == {("draft", "final"): 5}
    got = {r.group_id: (r.current_id, r.by) for r in survivors.most_current(df).collect()}
    assert got[100] == (101, "currency") and got[1] == (2, "time")


def test_currency_by_field_and_reachability(spark):
    at = lambda d: T(2020, 1, d)
    rows, n = [], 0

    def group(repo, *values, field="description"):
        nonlocal n
        first = n + 1
        for v, t in values:
            n += 1
            what = {"description": None, "paths": None, "keywords": None, "source": None} | {field: [v] if field in ("paths", "keywords") else v}
            rows.append((n, repo, "x", what["description"], what["paths"], what["keywords"], what["source"], t))
        return first

    for k, (v, w) in enumerate([("a", "b"), ("b", "c"), ("b", "d"), ("b", "e"), ("p", "q"), ("q", "r"), ("r", "p"), ("k", "l"), ("l", "m")]):
        for f in ("description", "keywords", "paths", "source"):
            group(1000 + 10 * k + len(f), (v, at(1)), (w, at(2)), field=f)
    want = {}
    for j, f in enumerate(("description", "keywords", "paths", "source")):
        for k, (values, place, by) in enumerate([
            ([("b", at(5)), ("a", None)], 0, "time"),  # by net degree a came after b
            ([("a", at(5)), ("c", None)], 1, "currency"),  # a path of two steps, never seen together
            ([("a", at(5)), ("b", None), ("e", None)], 2, "currency"),  # the last of three
            ([("p", at(5)), ("q", None)], 0, "time"),  # a cycle is no order
            ([("c", at(5)), ("m", None)], 0, "time"),  # nothing learned
            ([("m", None), ("l", None), ("k", None)], 0, "currency"),
            ([("k", None), ("l", None), ("m", None)], 2, "currency"),
        ]):
            first = group(1 + 100 * j + k, *values, field=f)
            want[first, f] = (first + place, by)
    got = {(r.group_id, r.field_name): (r.current_id, r.by) for r in survivors.most_current(spark.createDataFrame(rows, DOM)).collect()}
    assert {k: got.get(k) for k in want} == want and len(got) == len(want) + 36


def test_currency_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, rng.randint(1, 25), "x", rng.choice("abcdefghijkl") if rng.random() < 0.7 else f"own{i}", None, None, None, T(2020, 1, rng.randint(1, 20)) if rng.random() < 0.7 else None) for i in range(1, 121)]
    groups, net = {}, {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], r[3], r[7]))
    shared = {v for v in {r[3] for r in rows} if sum(v in {m[1] for m in ms} for ms in groups.values()) > 1}
    for members in groups.values():
        at = {}
        for _, v, t in members:
            if t and v in shared:
                at.setdefault(t, set()).add(v)
        line = [min(at[t]) for t in sorted(at) if len(at[t]) == 1]  # of several values at a time none is current
        for v, w in zip(line, line[1:]):
            if v != w:
                net[v, w], net[w, v] = net.get((v, w), 0) + 1, net.get((w, v), 0) - 1
    nodes = {v for v, _ in net}
    reach = {k for k, x in net.items() if x > 0}
    for k in nodes:
        reach |= {(v, w) for v in nodes if (v, k) in reach for w in nodes if (k, w) in reach}
    later = lambda v, w: (v, w) in reach and (w, v) not in reach
    want = {}
    for members in groups.values():
        if len(members) > 1:
            dated = sorted((m for m in members if m[2]), key=lambda m: (-m[2].timestamp(), m[0]))[:1]
            c = dated + [m for m in members if not m[2] and all(m[1] != d[1] for d in dated)]
            fit = [m for m in c if not m[2] and (not dated or later(dated[0][1], m[1]))] or dated
            best = min(m for m in fit if not any(later(m[1], o[1]) for o in fit))
            want[min(m[0] for m in members)] = (best[0], "time" if best[2] else "currency")
    got = {r.group_id: (r.current_id, r.by) for r in survivors.most_current(spark.createDataFrame(rows, DOM)).collect()}
    assert got == want and len(set(by for _, by in got.values())) == 2


TERMS = [(1, "ember-arbitration", "term", ["femupe"]), (2, "ember-arbitration", "team", []), (3, "hollow-ranking", "stage", None), (4, "quartz-retention", "module", ["pepiza"]), (5, "", "term", []), (6, None, None, None)]


@pytest.mark.parametrize(
    ("text", "term"),
    [("EmberArbitration", 1), ("arbitration of ember", 1), ("ARBITRATION, ember", 1), ("embr-arbitratoin", 1), ("emb. arbitr.", 1), ("emberarbitration", 1), ("the hollow ranking step", 3), ("skills/hollow-ranking.py", 3),
     ("ｈｏｌｌｏｗ－ｒａｎｋｉｎｇ", 3), ("hоllоw-rаnking", 3), ("PEPIZA ", 4), ("hollow ranking: see docs", 3), ("ember", -1), ("ranking", -1), ("ember lacquer", -1), ("hollow retention", -1), ("xxx", -1), ("日本語", -1), ("--", -1)],
)
def test_meant_entries(text, term):
    forms = {f: i for i, c, _, a in reversed(TERMS) for f in [c, *(a or [])] if f}
    form = canon.Index(sorted(forms)).map(tuple(canon.words(text)))[0]
    assert forms.get(form, -1) == term


def test_entries_of_any_rank():
    """An entry counts, as the one meant and as a rival, however many others have a larger cosine."""
    others = [f"holm {c}{d}" for c, d in zip("abcdefghijklmno", "qrstuvwxyzqrstu")]
    assert canon.Index([*others, "holographically"]).map(("hol",))[0] == "holographically"
    assert canon.Index([*others[:11], "holographs"]).map(("hol",))[0] == "holographs"
    assert canon.Index([*others[:11], "holographs", "holographically"]).map(("hol",))[0] is None
    for k in (0, 10, 24, 40, 200):
        alike = [f"emba{chr(97 + i % 26)}{chr(97 + i // 26)} arbo{i}" for i in range(k)]
        assert canon.Index(["embarkation-arbitration", *alike]).map(("embark", "arbit"))[0] == "embarkation-arbitration"
        far = [f"embankment archive{i}" for i in range(k)]  # look-alikes of which one word only begins as the value's
        assert canon.Index(["embarkation-arbitration", *far]).map(("emb", "arb"))[0] == "embarkation-arbitration"


def test_values_are_mapped_once(spark):
    """The scoring function stands above the aggregates that make the values distinct, and nowhere below."""
    df = spark.createDataFrame([("a b",), ("A-B",), (None,)], "v string")
    plan = canon.map_values(df, "v", ["a b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mapped(") == 1 and plan.index("mapped(") < plan.index("Aggregate")


def test_no_coverable_entry_is_passed_over():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 9)))
    base = [word() for _ in range(40)]
    index = canon.Index(sorted({" ".join(rng.sample(base, rng.randint(1, 3))) for _ in range(80)} | {"--", "été"}))
    seen = 0
    for _ in range(800):
        ws = list(rng.choice(index.words)) or ["x"]
        k = rng.randrange(len(ws))
        j = rng.randrange(len(ws[k]))
        ws[k] = rng.choice([ws[k], ws[k] + "s", ws[k][: max(3, j)], ws[k][:j] + rng.choice("abz日") + ws[k][j:], ws[k][:j] + ws[k][j + 1 :], ws[k][:j] + ws[k][j : j + 2][::-1] + ws[k][j + 2 :]])
        value = [w for w in rng.choice([ws, ["".join(ws)], ["".join(ws[::-1])], ws + [word()], ws[::-1]]) if w]
        value = tuple(value)
        runs = {v for v in value if v not in index.known} | ({"".join(value)} if any(v not in index.known for v in value) else set())
        every = [{w: s for w in index.vocabulary if (s := float(v == w) if v in index.known else canon.alike(v, w)) >= canon.ACCEPT} for v in value]
        near = [index.near(v) for v in value]
        assert near == every  # the n-gram index passes no word over
        right = {i for i, e in enumerate(index.words) if e and max(index._spelled(every, i), index._run_together(value, runs, i)) > 0} if value else set()
        assert right <= index.candidates(value, near, runs)
        seen += len(right)
    assert seen > 800


def test_alias_rows(spark):
    rows = [
        (1, "x", "Ember Arbitration", "TEAM "), (2, "femupe", "?", "team"), (3, "femupe", " TBD ", None), (4, None, "-", None), (5, None, None, "t"), (6, " ", "", "t"), (7, "hollow-ranking", None, "zzz"),
        (8, "ember-arbitration", None, None), (8, "ember-arbitration", None, None), (9, "q" * 100_000, "", None), (10, "x " * 50_000, None, None),
    ]
    df = spark.createDataFrame(rows, "alias_id long, alias string, canonical string, kind string").withColumn("term_id", F.lit(0)).withColumn("form", F.lit("clash"))
    terms = spark.createDataFrame(TERMS, "term_id long, canonical string, kind string, known_aliases array<string>")
    got = sorted(tuple(r) for r in canon.alias_terms(df, terms).collect())
    assert got == [(1, 2), (2, 1), (3, 1), (4, -1), (7, 3), (8, 1), (8, 1), (9, -1), (10, -1)]
    assert canon.alias_terms(df.limit(0), terms).count() == 0 and {r.term_id for r in canon.alias_terms(df, terms.limit(0)).collect()} == {-1}


def test_mapping_accuracy_on_noised_names():
    """Names with a stated kind of noise come back; words that don't belong together never do."""
    rng = random.Random(5)
    a, b = "anchor barrel basalt cinder cobalt dossier falcon garnet harbor island meadow nickel".split(), "annotation baseline calibration discovery extraction ingestion promotion ranking retention validation".split()
    names = rng.sample([f"{x}-{y}" for x in a for y in b], 70)
    index = canon.Index(sorted(names))

    def typo(w):
        i = rng.randrange(1, len(w) - 1)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])

    good = 0
    for n in names:
        x, y = n.split("-")
        good += sum(index.map(tuple(canon.words(t)))[0] == n for t in (f"{typo(x)} {y}", f"{x}-{typo(y)}", f"{y} of {x}", f"{x[:4]}. {y[:6]}.", (x + y).upper()))
    assert good >= 0.98 * 5 * len(names)
    others = [f"{x} {y}" for x in a for y in b if f"{x}-{y}" not in names]
    assert not [t for t in others if index.map(tuple(canon.words(t)))[0]]
