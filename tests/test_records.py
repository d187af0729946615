"""Hints, checks and projections on nulls, empty values and clashing names."""

import json

from pyspark.sql import functions as F

from strataforge.functions import extract, scoring
from strataforge.operators import aggregates, joins, validate


def test_hints(spark):
    hints = {"ownership_hints": [{"path_prefix": "src/", "capability": "auth"}, {"scope": " ", "owner": "x"}, {"scope": "a", "owner": "b", "note": "c"}], "seed_concepts": ["one ", "", {"title": "two", "summary": "2"}, {"concept": "three"}, {"x": 1}, 5]}
    df = spark.createDataFrame([(1, json.dumps({"shared_hints": hints})), (2, None), (3, "{cut"), (4, "{}")], "id long, p string")
    got = {r.id: r for r in df.select("id", extract.ownership_hints(F.col("p")).alias("o"), extract.seed_concepts(F.col("p")).alias("s")).collect()}
    assert [tuple(x) for x in got[1].o] == [("src/", "auth", "src/"), ("a", "b", "c")]
    assert [tuple(x) for x in got[1].s] == [("one", "one"), ("two", "2"), ("three", "three")]
    assert all(not got[i].o and not got[i].s for i in (2, 3, 4))


def test_checks_of_json(spark):
    texts = [None, "", "[]", "{}", '{"demand_card":1}', '{"demand_card":{},"x":1}', '{"demand_card":{"mapping":{"domains":["a",null," ",2,{}]}}}']
    df = validate.with_json(spark.createDataFrame(list(enumerate(texts)), "id int, json_text string"), F.col("json_text"))
    got = {r.id: r for r in df.select("id", validate.card_errors(F.col("json")).alias("c"), validate.signal_errors(F.col("json")).alias("s"), validate.case_failure(F.col("json")).alias("f")).collect()}
    assert got[0].c == got[1].c == got[2].c == ["object expected"] and got[3].c == got[4].c == ["demand_card: object expected"]
    assert got[5].c[0] == "x: unknown field" and "demand_card.uncertainties: object expected" in got[5].c
    assert [e for e in got[6].c if "domains" in e] == [f"demand_card.mapping.domains[{i}]: text expected" for i in (1, 2, 3, 4)]
    assert got[0].s == ["no document"] and got[2].s == ["object expected"] and got[3].s == [] and got[0].f == "object expected" and got[3].f == "case_id: missing"


def test_sections_and_reasons(spark):
    texts = [None, " ", "## A\n\n# only\n## B\ntext Pipeline: x\n", "## A\nfirst\n## A\n", "no heading"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.e for r in df.select("id", validate.section_errors(F.col("t"), ("A", "B"), {"B": ("pipeline:",)}).alias("e")).collect()}
    assert got == {0: ["empty text"], 1: ["empty text"], 2: ["A: nothing but headings"], 3: ["A: empty", "B: missing"], 4: ["A: missing", "B: missing"]}
    one = spark.range(1).select(
        scoring.invariants(F.lit(None).cast("array<string>"), F.array(F.lit("m"), F.lit("m")), F.array()).alias("a"), scoring.invariants(F.array().cast("array<string>"), F.array().cast("array<string>"), F.array(F.lit("x must y"), F.lit("z"))).alias("b"),
        scoring.validity_reason(F.lit(None).cast("string"), F.lit(None).cast("int"), {"name": F.lit("")}).alias("r"), scoring.evidence_gap(F.lit("pass"), F.lit("high"), F.lit(None).cast("int")).alias("g"),
    ).first()
    assert (one.a, one.b, one.r, one.g) == (["m"], ["x must y"], "missing: name", "high confidence without evidence")


def test_nested_units_and_logs(spark):
    item = "array<struct<op: string, summary: string>>"
    rows = [("a", [("s", "t", "primary", "all", [("feat", None), ("docs", "d")]), ("e", "t", None, "none", [])]), ("b", None), ("c", [])]
    df = spark.createDataFrame(rows, f"sha string, sections array<struct<name: string, theme: string, importance: string, summary: string, items: {item}>>")
    got = [tuple(r) for r in aggregates.nested_units(df, "sections", ["sha"]).collect()]
    assert got == [("a", "s", "t", "primary", "feat", "all"), ("a", "s", "t", "primary", "docs", "d"), ("a", "e", "t", None, None, "none"), ("b", None, None, None, None, None), ("c", None, None, None, None, None)]
    log = aggregates.change_log(spark.createDataFrame([("keep", "n", "k", "r", "t"), ("merge", "m", "k", None, "t"), (None, "x", "k", "r", "t"), ("odd", "y", "k", "r", "t")], "a string, n string, k string, r string, t string"), "a", "n", "k", "r", "t")
    assert [tuple(r) for r in log.collect()] == [("added", "n", "k", "r", None), ("merged", "m", "k", None, "t")]


def test_merged_signals_are_whole(spark):
    """A category of more than ten thousand values keeps all of them, in order."""
    df = spark.range(25_000).select(F.lit("c").alias("category"), (F.col("id") % 7).alias("doc"), "id", F.col("id").cast("string").alias("v"))
    got = aggregates.merged_signals(df, "doc", "id", "category", "v")
    assert got.count() == 25_000 and [(r.doc, r.id) for r in got.limit(3).collect()] == [(0, 0), (0, 7), (0, 14)]


def test_prefixes_of_many_lengths(spark, monkeypatch):
    """Beyond the lengths that are sent along paths are cut everywhere: the same result."""
    facts = spark.createDataFrame([(1, 1, ["abcdef/x"]), (2, 1, ["abz", ""]), (3, 1, None)], "id long, k long, paths array<string>")
    dims = spark.createDataFrame([("short", 1, 1, ["ab"]), ("long", 2, 1, ["abcdef/"])], "name string, o long, k long, pre array<string>")
    run = lambda: {r.id: r.name for r in joins.prefix_winner(facts, dims, ["k"], "id", "paths", "name", "pre", "o").collect()}
    want = run()
    monkeypatch.setattr(joins, "MAX_LENGTHS", 1)
    assert run() == want == {1: "long", 2: "short", 3: None}
