"""A repository's history as a DataFrame: ``spark.read.format("gitlog").option("repo", path)``.

The driver lists the commits once; each partition reads the details of a slice of them with one git process. Options:
repo, range, since, until, author, no_merges, per_partition, exclude (path prefixes, separated by commas), diff (true: with
the text of the changes, cut at each file). A failing git ends the job with its message.
"""

from __future__ import annotations

import re
import subprocess
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sha string, author string, date string, message string, files array<string>, insertions bigint, deletions bigint, binaries bigint, diff_chunks array<string>, related_tests array<string>"


def _git(repo: str, *args: str, stdin: str | None = None) -> str:
    done = subprocess.run(["git", "-C", repo, *args], input=stdin, capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.strip()}")
    return done.stdout


class _Slice(InputPartition):
    def __init__(self, shas: list[str]):
        self.shas = shas


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.o = {k.lower(): v for k, v in options.items()}
        if "repo" not in self.o:
            raise ValueError("option repo is required")

    def partitions(self) -> list[InputPartition]:
        args = ["rev-list"]
        for k in ("since", "until", "author"):
            if self.o.get(k):
                args.append(f"--{k}={self.o[k]}")
        if self.o.get("no_merges", "").lower() == "true":
            args.append("--no-merges")
        rev = self.o.get("range", "HEAD")
        if rev.startswith("-"):
            raise ValueError("range must not look like an option")
        shas = _git(self.o["repo"], *args, rev, "--").split()
        n = int(self.o.get("per_partition", 500))
        return [_Slice(shas[i : i + n]) for i in range(0, len(shas), n)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        if not partition.shas:
            return
        mark = uuid.uuid4().hex  # changes may hold any text
        excluded = tuple(p for p in self.o.get("exclude", "").split(",") if p)
        patch = ["-p", "--no-color", "--no-ext-diff"] if self.o.get("diff", "").lower() == "true" else []
        form = "%x1f".join([f"{mark}%H", "%an", "%aI", f"%B{mark}:"])
        out = _git(self.o["repo"], "log", "--no-walk=unsorted", "--stdin", "--numstat", *patch, f"--format={form}", stdin="\n".join(partition.shas) + "\n")
        for sha, author, date, message, stat, chunks in _commits(out, mark):
            files, ins, dele, binaries = [], 0, 0, 0
            for line in stat:
                a, b, path = line.split("\t", 2)
                if path.startswith(excluded):
                    continue
                files.append(path)
                if a == "-":
                    binaries += 1
                else:
                    ins, dele = ins + int(a), dele + int(b)
            kept = [c for c in chunks if not _path_of(c).startswith(excluded)] if excluded else chunks
            yield sha, author, date, message, files, ins, dele, binaries, kept if patch else None, [f for f in files if "test" in f.lower()]


def _commits(out: str, mark: str) -> Iterator[tuple]:
    """(sha, author, date, message, lines of the statistics, changes by file) of the log's output."""
    parts = out.split(mark)[1:]  # what stands before and behind the second mark of each commit
    for head, tail in zip(parts[::2], parts[1::2]):
        sha, author, date, message = head.split("\x1f", 3)
        stat, *chunks = re.split(r"(?m)^(?=diff --git )", tail[1:])
        yield sha, author, date, message.strip(), stat.strip().splitlines(), chunks


def _path_of(chunk: str) -> str:
    """The path that a change begins with."""
    m = re.match(r"diff --git a/(\S+)", chunk)
    return m[1] if m else ""


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def history(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    spark.dataSource.register(GitLog)
    return spark.read.format("gitlog").option("repo", repo).options(**options).load()


def weight() -> Column:
    """500 per binary file plus insertions plus deletions."""
    return F.col("binaries") * 500 + F.col("insertions") + F.col("deletions")


def files_by_commit(log: DataFrame, listing: str, line: str, order: str, marker: str) -> DataFrame:
    """(sha, files) of the lines of listings in which marker lines name the commit of those below them.

    A listing is the output of one command and is read in its order; different listings are read apart. Lines before the
    first marker and blank ones are left out.
    """
    from pyspark.sql import Window as W

    sha = F.when(F.startswith(line, F.lit(marker)), F.trim(F.substr(line, F.lit(len(marker) + 1))))
    rows = log.select(listing, order, line, sha.alias("_m")).withColumn("sha", F.last("_m", ignorenulls=True).over(W.partitionBy(listing).orderBy(order)))
    at = F.struct(listing, order, line)
    g = rows.filter(F.col("sha").isNotNull()).groupBy("sha").agg(F.array_sort(F.collect_list(F.when(F.col("_m").isNull() & (F.trim(line) != ""), at))).alias("f"))  # the files of one commit
    return g.select("sha", F.transform("f", lambda x: x[line]).alias("files"))
