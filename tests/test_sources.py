"""Files, git, sinks and streams."""

import json
import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strataforge.sources import git, readers, writers
from strataforge.streaming import incremental

SCHEMA = StructType([StructField("sha", StringType()), StructField("date", StringType()), StructField("extra", LongType())])


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_jsonl(spark, tmp_path):
    write(f"{tmp_path}/in/2024-01.jsonl", '{"sha":"a","date":"2024-01-02"}\n\n{"sha":"b"\n{"sha":"é","extra":1}\n')
    write(f"{tmp_path}/in/notes.jsonl", '{"sha":"zz"}\n')
    df = readers.jsonl(spark, f"{tmp_path}/in", SCHEMA, skip_errors=True, glob="????-??.jsonl", ordinals=True)
    assert [r.sha for r in df.orderBy("_file", "_line").collect()] == ["a", "é"]
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, f"{tmp_path}/in", SCHEMA).collect()
    writers.jsonl(df.select("sha"), f"{tmp_path}/out")
    writers.jsonl(df.select("sha"), f"{tmp_path}/out", append=True)
    assert spark.read.json(f"{tmp_path}/out").count() == 4


def test_months(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "sha string, date string, extra long, o long")
    p = f"{tmp_path}/months"
    assert writers.append_months(rows(("a", "2024-01-01", 1, 1), ("a", "2024-01-01", 2, 2), ("b", None, 1, 3), (None, "2024-01-01", 1, 4)), p, "sha", "date", ["o"]) == 2
    assert writers.append_months(rows(("a", "2024-01-09", 9, 5), ("c", "2024-02-01", 1, 6)), p, "sha", "date", ["o"]) == 1
    got = {(r.sha, r.extra, r.month) for r in spark.read.option("basePath", p).schema("sha string, extra long, month string").parquet(p).collect()}
    assert got == {("a", 2, "2024-01"), ("b", 1, "unknown"), ("c", 1, "2024-02")}


def test_files(spark, tmp_path):
    write(f"{tmp_path}/r/README.md", "x" * 50)
    write(f"{tmp_path}/r/empty.md", "")
    write(f"{tmp_path}/r/a/m.py", "class A: pass\ndef f(): pass\n")
    write(f"{tmp_path}/r/__pycache__/m.py", "def g(): pass\n")
    write(f"{tmp_path}/r/p.md", "Goal:\nDo it\nRules:\n- one\n - two\n")
    assert [(r.name, len(r.text)) for r in readers.candidate_texts(spark, f"{tmp_path}/r", ["README.md", "none.md", "empty.md"], 10).collect()] == [("README.md", 10)]
    assert readers.tree(spark, f"{tmp_path}/r").count() == 3
    assert {r.name for r in readers.source_symbols(spark, f"{tmp_path}/r").collect()} == {"A", "f"}  # folders that begin with _ are hidden from Spark
    got = {r.section: (r.body, r.bullets) for r in readers.prompt_sections(readers.texts(spark, f"{tmp_path}/r/p.md"), "path", "text").collect()}
    assert got == {"Goal": ("Do it", []), "Rules": ("- one\n - two", ["one", "two"])}
    want = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "name string, required boolean")
    have = spark.createDataFrame([("a", 5), ("b", 0)], "name string, bytes long")
    assert {(r.name, r.issue) for r in readers.preflight(want, have).collect()} == {("b", "invalid: empty"), ("c", "warning: absent"), ("d", "missing")}
    pytest.importorskip("yaml")
    write(f"{tmp_path}/y/a.yaml", "name: x\nitems: [1, 2]\n")
    write(f"{tmp_path}/y/b.yaml", "- 1\n")
    got = {os.path.basename(r.path): r.data for r in readers.yaml_objects(spark, f"{tmp_path}/y", "name string, items array<int>").collect()}
    assert tuple(got["a.yaml"]) == ("x", [1, 2]) and got["b.yaml"] is None


def test_git(spark, tmp_path):
    repo = f"{tmp_path}/g"
    os.makedirs(repo)
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(5):
        write(f"{repo}/f{i}.txt", f"line {i}\n" * (i + 1))
        run("add", ".")
        run("commit", "-q", "-m", f"change {i}")
    df = git.history(spark, repo, per_partition="2")
    rows = {r.message: (r.files, r.w) for r in df.select("message", "files", git.weight().alias("w")).collect()}
    assert rows == {f"change {i}": ([f"f{i}.txt"], i + 1) for i in range(5)}
    with pytest.raises(Exception, match="git rev-list failed"):
        git.history(spark, f"{tmp_path}/none").collect()
    os.makedirs(f"{repo}/docs")
    write(f"{repo}/docs/test_a.md", "x\x1e diff --git a/no b/no\n")
    write(f"{repo}/test_b.txt", "diff\n")
    run("add", ".")
    run("commit", "-q", "-m", "last\n\nwith a body")
    last = git.history(spark, repo, diff="true", exclude="docs/,f0", per_partition="3").filter("message like 'last%'").first()
    assert last.message == "last\n\nwith a body" and last.files == ["test_b.txt"] == last.related_tests and last.insertions == 1
    assert len(last.diff_chunks) == 1 and last.diff_chunks[0].startswith("diff --git a/test_b.txt b/test_b.txt\n") and last.diff_chunks[0].endswith("+diff\n")
    log = spark.createDataFrame([("p", 0, "noise"), ("p", 1, "@@a"), ("p", 2, "x"), ("p", 3, ""), ("p", 4, "y"), ("p", 5, "@@b"), ("q", 0, "z"), ("q", 1, "@@c"), ("q", 2, "w")], "f string, o long, l string")
    assert {r.sha: r.files for r in git.files_by_commit(log, "f", "l", "o", "@@").collect()} == {"a": ["x", "y"], "b": [], "c": ["w"]}


def test_versions_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "auth-core", "s")], "id long, name string, summary string")
    assert [writers.new_version(df, f"{tmp_path}/v", "map") for _ in range(2)] == [1, 2]
    writers.small_json(df, f"{tmp_path}/one.json")
    assert json.load(open(f"{tmp_path}/one.json"))["name"] == "auth-core"
    bad = writers.checked(df, F.array(F.lit("no")), f"{tmp_path}/c")
    assert bad.count() == 1 and not os.path.exists(f"{tmp_path}/c")
    writers.checked(df, F.array().cast("array<string>"), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 1
    assert [r.text for r in writers.report(df, "Maps", "name", {"ID": "id"}, "id").collect()] == ["# Maps\n\n**Total**: 1", "## auth-core\n- **ID**: 1"]
    assert df.select(writers.pascal(F.col("name")).alias("p"), writers.camel(F.lit("x_y")).alias("c")).collect()[0] == ("AuthCore", "xY")
    assert "type AuthCore {" in writers.graphql_types(df, "name", "summary").collect()[0].definition


def _drain(stream, tmp, name, mode="append", fn=None):
    w = stream.writeStream.option("checkpointLocation", f"{tmp}/cp_{name}").trigger(availableNow=True).outputMode(mode)
    q = (w.foreachBatch(fn) if fn else w.format("memory").queryName(name)).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streams(spark, tmp_path):
    src, schema = f"{tmp_path}/src", "k string, v string, at timestamp, level string, outcome string"
    put = lambda n, rows: spark.createDataFrame(rows, "k string, v string, at string, level string, outcome string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    put(1, [("a", "1", "2024-01-01 00:00:00", "high", "accepted"), ("a", "1", "2024-01-01 00:01:00", "high", "rejected"), ("b", "1", "2024-01-01 00:02:00", "low", "x")])
    time.sleep(1.1)
    put(2, [("a", "2", "2024-01-01 00:03:00", "high", "accepted"), ("c", "1", "2024-01-01 05:00:00", "low", "accepted")])
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    _drain(incremental.unseen(read(), ["k"], "at", "1 hour").select("k"), tmp_path, "uniq")
    assert sorted(r.k for r in spark.table("uniq").collect()) == ["a", "b", "c"]
    _drain(incremental.outcome_counts(read(), "at", "10 minutes", "1 hour", "level", "outcome"), tmp_path, "counts", "append")
    assert {(r.level, r.accepted, r.rejected, r.total) for r in spark.table("counts").collect()} == {("high", 2, 1, 3), ("low", 0, 0, 1)}
    out = f"{tmp_path}/changed"
    fn = incremental.append_changed("k", "v", out)
    _drain(read(), tmp_path, "changed", fn=fn)
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")]
    fn(spark.createDataFrame([("c", "1"), ("d", "4")], "k string, v string"), 7)
    fn(spark.createDataFrame([("c", "1"), ("d", "4")], "k string, v string"), 7)  # a retried batch
    assert spark.read.parquet(out).count() == 5
    _drain(incremental.live_entries(read(), "k", "v", "at", 3600), tmp_path, "live")
    got = sorted((r.k, r.state) for r in spark.table("live").collect())
    assert ("a", "new") in got and ("a", "changed") in got and ("a", "expired") in got and ("c", "new") in got
