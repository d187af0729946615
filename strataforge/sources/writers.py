"""Sinks: JSONL, month partitions without repeats, versions, reports, work lists."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.scoring import month_of
from strataforge.operators import dedup


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object per row, UTF-8; overwritten unless appended to."""
    df.write.mode("append" if append else "overwrite").json(path)


def small_json(df: DataFrame, path: str) -> None:
    """A one-row result as a pretty JSON file, replaced atomically."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("one row is expected")
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(json.loads(rows[0]), f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(path + ".tmp", path)


def small_yaml(df: DataFrame, path: str) -> None:
    """A one-row result as a YAML file, replaced atomically. Needs PyYAML on the driver."""
    import yaml

    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("one row is expected")
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        yaml.safe_dump(json.loads(rows[0]), f, allow_unicode=True, sort_keys=False)
    os.replace(path + ".tmp", path)


def append_months(df: DataFrame, path: str, key: str, date: str, order: list[str]) -> int:
    """Append the rows whose key isn't yet in their month, the last of each key; rows without a key are left out.

    Only the months that the new rows fall in are read. Gives the number of rows appended.
    """
    spark = df.sparkSession
    new = dedup.last_wins(df, [key], order).withColumn("month", month_of(F.col(date)))
    if _exists(spark, path):
        months = [r.month for r in new.select("month").distinct().collect()]  # few: one per month
        old = spark.read.parquet(path).filter(F.col("month").cast("string").isin(months)).select(key, F.col("month").cast("string").alias("month"))
        new = new.join(old, [key, "month"], "left_anti")
    from pyspark.sql import Observation

    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("month").parquet(path)
    return seen.get["n"]


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def checked(df: DataFrame, errors: Column, path: str) -> DataFrame:
    """Write all rows if none has errors, else none; gives the rows with errors."""
    bad = df.withColumn("errors", errors).filter(F.size("errors") > 0)
    if bad.isEmpty():
        df.write.mode("overwrite").parquet(path)
    return bad


def new_version(df: DataFrame, path: str, name: str, tries: int = 64) -> int:
    """Write as the next version of an artifact: a folder name.vN that nobody else has made."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs.mkdirs(top)
    taken = [s.getPath().getName() for s in fs.listStatus(top)]
    n = max([int(t.rsplit(".v", 1)[1]) for t in taken if t.startswith(f"{name}.v") and t.rsplit(".v", 1)[1].isdigit()], default=0)
    for v in range(n + 1, n + 1 + tries):
        # a marker created exclusively decides who has the version
        try:
            fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, f"_{name}.v{v}.lock"), False).close()
        except Exception:  # noqa: BLE001, another writer was first
            continue
        df.write.mode("errorifexists").parquet(f"{path}/{name}.v{v}")
        return v
    raise RuntimeError(f"no free version of {name} within {tries}")


def report(df: DataFrame, title: str, heading: str, lines: dict[str, str], order: str) -> DataFrame:
    """A Markdown report as rows of text, in order: a title and a section per row of df."""
    body = F.concat_ws("\n", F.concat(F.lit("## "), F.col(heading)), *(F.concat(F.lit(f"- **{k}**: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for k, c in lines.items()))
    head = df.agg(F.concat(F.lit(f"# {title}\n\n**Total**: "), F.count("*").cast("string")).alias("text")).select(F.lit(0).alias("part"), F.lit(None).cast(dict(df.dtypes)[order]).alias(order), "text")
    return head.unionByName(df.select(F.lit(1).alias("part"), order, body.alias("text"))).orderBy("part", order).select("text")


def work_list(batches: DataFrame, batch: list[str], item: str, prompt: str) -> DataFrame:
    """One row per batch: its items in order and the text that goes with them. Batches are bounded by their budget."""
    return batches.groupBy(*batch).agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("prompt", F.lit(prompt))


def pascal(name: Column) -> Column:
    """some-name_here as SomeNameHere."""
    return F.array_join(F.transform(F.filter(F.split(name, r"[^A-Za-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def camel(name: Column) -> Column:
    p = pascal(name)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))


def graphql_types(concepts: DataFrame, name: str, summary: str) -> DataFrame:
    """(definition) of one GraphQL type per concept, names in Pascal case, the summary as description."""
    text = F.regexp_replace(F.coalesce(summary, F.lit("")), '"', "'")
    return concepts.select(F.concat(F.lit('"""'), text, F.lit('"""\ntype '), pascal(F.col(name)), F.lit(" {\n  id: ID!\n  name: String!\n}")).alias("definition"))
