"""Files as DataFrames: JSONL, JSON and YAML objects, whole texts, trees, sections of prompts, source symbols."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from strataforge.functions import extract

_CORRUPT = "_corrupt_record"


def jsonl(spark: SparkSession, path: str, schema: StructType, skip_errors: bool = False, glob: str | None = None, ordinals: bool = False) -> DataFrame:
    """One row per line; blank lines are skipped. A line that is no JSON object ends the job, or is left out.

    glob keeps files by name, such as ????-??.jsonl for monthly ones. With ``ordinals`` rows carry file and line order (_file,
    _line: increasing within a file), which last-wins merging needs.
    """
    reader = spark.read.schema(StructType([*schema.fields]).add(_CORRUPT, StringType())).option("columnNameOfCorruptRecord", _CORRUPT)
    reader = reader.option("mode", "PERMISSIVE" if skip_errors else "FAILFAST")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.json(path)
    if ordinals:
        df = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_line", F.monotonically_increasing_id())
    extra = ["_file", "_line"] if ordinals else []
    return df.filter(F.col(_CORRUPT).isNull()).select(*[f.name for f in schema.fields], *extra)


def json_object(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file with one JSON object, over several lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def texts(spark: SparkSession, path: str, most: int | None = None, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, text) of whole files, the text cut to ``most`` characters where a cap is the feature; empty files left out."""
    r = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if most is not None:
        df = df.withColumn("text", F.substring("text", 1, most))
    return df.filter(F.length("text") > 0)


def candidate_texts(spark: SparkSession, root: str, names: list[str], most: int = 3000) -> DataFrame:
    """The first ``most`` characters of those of the named files that exist, in the order of the list."""
    listed = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, name string")
    found = texts(spark, root, most, recursive=True)
    rel = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/") + r"\E/", "")
    return found.withColumn("name", rel).join(F.broadcast(listed), "name").select("ord", "name", "text")


def yaml_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, data) of YAML files as the given struct; a file that is no mapping gives null. Needs PyYAML on the executors."""

    @F.pandas_udf("string")
    def as_json(s: pd.Series) -> pd.Series:
        import yaml

        def one(t):
            try:
                v = yaml.safe_load(t)
            except yaml.YAMLError:
                return None
            return json.dumps(v, default=str, ensure_ascii=False) if isinstance(v, dict) else None

        return s.map(one)

    return texts(spark, path).select("path", F.from_json(as_json("text"), schema).alias("data"))


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, body) of texts that begin with a YAML block between lines of three hyphens; meta is JSON, null where
    there is no block or it is no mapping. Needs PyYAML on the executors."""

    @F.pandas_udf("string")
    def as_json(s: pd.Series) -> pd.Series:
        import yaml

        def one(t):
            try:
                v = yaml.safe_load(t) if t else None
            except yaml.YAMLError:
                return None
            return json.dumps(v, default=str, ensure_ascii=False) if isinstance(v, dict) else None

        return s.map(one)

    block = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"
    t = texts(spark, path)
    return t.select("path", as_json(F.regexp_extract("text", block, 1)).alias("meta"), F.regexp_replace("text", block, "").alias("body"))


def folder_texts(spark: SparkSession, folder: str, most: int = 3000) -> DataFrame:
    """(path, text) of all files of a folder in the order of their paths, the first ``most`` characters of each."""
    return texts(spark, folder, most).orderBy("path")


def tree_total(spark: SparkSession, root: str, excluded: tuple[str, ...] = (".git/", "node_modules/", "__pycache__/")) -> DataFrame:
    """One row (files, bytes): what ``tree`` lists a part of."""
    return _files(spark, root, excluded).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def _files(spark: SparkSession, root: str, excluded: tuple[str, ...]) -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    for e in excluded:
        df = df.filter(~F.contains("path", F.lit("/" + e)))
    return df


def tree(spark: SparkSession, root: str, most: int = 200, excluded: tuple[str, ...] = (".git/", "node_modules/", "__pycache__/")) -> DataFrame:
    """(path, bytes) of the first ``most`` files by path, without excluded folders and empty files; the cap is the feature of a summary."""
    return _files(spark, root, excluded).orderBy("path").limit(most)


def selected_texts(files: DataFrame, listing: DataFrame, text: str, label: str, most: int = 10_000) -> DataFrame:
    """(path, text) of the files named in the bullets below a label of a text; files is (path, text)."""
    from strataforge.operators.windows import bullets_after

    named = listing.select(F.explode(bullets_after(F.col(text), label)).alias("path")).distinct()
    return files.join(named, "path", "left_semi").withColumn("text", F.substring("text", 1, most))


def prompt_sections(prompts: DataFrame, path: str, text: str) -> DataFrame:
    """(path, section, body, bullets) of texts with lines 'Section:'; the lines up to the next one are its body."""
    parts = F.filter(F.split(text, r"(?m)(?=^[A-Z][A-Za-z ]*:\s*$)"), lambda p: p.rlike(r"^[A-Z][A-Za-z ]*:"))
    p = prompts.select(path, F.explode(parts).alias("p"))
    body = F.trim(F.regexp_replace("p", r"(?s)^[^\n]*\n?", ""), F.lit(" \n\r\t"))
    bullets = F.regexp_extract_all(body, F.lit(r"(?m)^\s*[-*]\s+(.+?)\s*$"), 1)
    return p.select(path, F.substring_index("p", ":", 1).alias("section"), body.alias("body"), bullets.alias("bullets"))


def source_symbols(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, name, line) of all Python files below a folder."""
    return extract.symbol_table(texts(spark, root, glob="*.py", recursive=True), "path", "text")


def preflight(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """(name, issue): expected inputs (name, required) that are missing or empty in the listing (name, bytes)."""
    j = expected.join(listing, "name", "left")
    issue = F.when(F.col("bytes").isNull(), F.when(F.col("required"), "missing").otherwise("warning: absent")).when(F.col("bytes") == 0, "invalid: empty")
    return j.select("name", issue.alias("issue")).filter("issue is not null")
