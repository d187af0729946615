"""Taking structure out of text: JSON and fences, diffs, labelled values, symbols and facts."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.operators.dedup import ordered_distinct, ordered_distinct_ci


def without_fences(text: Column) -> Column:
    """A text that begins with a code fence, without its fence lines; others only trimmed."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    return F.when(F.startswith(t, F.lit("```")), F.trim(F.regexp_replace(t, r"(?m)^[ \t]*```.*$\n?", ""), F.lit(" \t\r\n"))).otherwise(t)


def json_objects(text: Column, schema: str, required: list[str]) -> Column:
    """Objects of a JSON array (fences aside) that have all required fields; null where the text is no array."""
    arr = F.from_json(without_fences(text), f"array<{schema}>", {"mode": "PERMISSIVE"})

    def ok(x):
        out = x.isNotNull()
        for r in required:
            out = out & x[r].isNotNull()
        return out

    return F.filter(arr, ok)


def aliases(payload: Column, path: str = "$.shared_hints.aliases") -> Column:
    """array<struct<canonical, alias, kind>> of a repo context: trimmed, fields with fallbacks, incomplete ones left out."""
    raw = F.from_json(F.get_json_object(payload, path), "array<struct<canonical: string, domain: string, alias: string, name: string, kind: string>>")
    some = lambda *cs: F.trim(F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit("")))
    made = F.transform(raw, lambda x: F.struct(some(x["canonical"], x["domain"]).alias("canonical"), some(x["alias"], x["name"]).alias("alias"), F.coalesce(F.nullif(F.trim(F.coalesce(x["kind"], F.lit("term"))), F.lit("")), F.lit("term")).alias("kind")))
    return F.filter(made, lambda x: (x["canonical"] != "") & (x["alias"] != ""))


def _first_of(x: Column, *names: str) -> Column:
    return F.trim(F.coalesce(*(F.nullif(x[n], F.lit("")) for n in names), F.lit("")))


def ownership_hints(payload: Column, path: str = "$.shared_hints.ownership_hints") -> Column:
    """array<struct<scope, owner, note>> of a repo context, fields with fallbacks; incomplete ones are left out."""
    raw = F.from_json(F.get_json_object(payload, path), "array<struct<scope: string, path_prefix: string, capability: string, owner: string, note: string, description: string>>")
    made = F.transform(raw, lambda x: F.struct(
        _first_of(x, "scope", "path_prefix", "capability").alias("scope"), _first_of(x, "owner", "capability", "path_prefix").alias("owner"),
        F.coalesce(F.nullif(_first_of(x, "note", "description", "path_prefix"), F.lit("")), _first_of(x, "owner", "capability", "path_prefix")).alias("note"),
    ))
    return F.filter(made, lambda x: (x["scope"] != "") & (x["owner"] != "") & (x["note"] != ""))


def seed_concepts(payload: Column, path: str = "$.shared_hints.seed_concepts") -> Column:
    """array<struct<name, description>> of a repo context: texts, or objects whose fields have fallbacks; nameless ones are left out."""
    elements = F.try_variant_get(F.try_parse_json(F.get_json_object(payload, path)), "$", "array<variant>")

    def one(v):
        at = lambda *names: F.trim(F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names), F.lit("")))
        text = F.trim(F.try_variant_get(v, "$", "string"))
        name = F.when(F.schema_of_variant(v) == "STRING", text).otherwise(at("name", "concept", "title"))
        said = F.nullif(at("description", "summary"), F.lit(""))
        return F.struct(name.alias("name"), F.when(F.schema_of_variant(v) == "STRING", text).otherwise(F.coalesce(said, name)).alias("description"))

    return F.filter(F.transform(elements, one), lambda x: F.coalesce(x["name"], F.lit("")) != "")


def diff_chunks(diff: Column) -> Column:
    """The parts of a diff, each from its 'diff --git' line on; blank parts are left out."""
    return F.filter(F.split(diff, r"(?m)(?=^diff --git )"), lambda x: F.trim(x) != "")


def chunk_path(chunk: Column) -> Column:
    """The path after b/ of a chunk's first line; empty if there is none."""
    return F.regexp_extract(chunk, r"^diff --git a/\S+ b/(\S+)", 1)


def added_lines(chunk: Column) -> Column:
    return F.size(F.regexp_extract_all(chunk, F.lit(r"(?m)^(\+)(?!\+\+ )"), 1)).cast("bigint")


def removed_lines(chunk: Column) -> Column:
    return F.size(F.regexp_extract_all(chunk, F.lit(r"(?m)^(-)(?!-- )"), 1)).cast("bigint")


def kept_files(files: Column, excluded: list[str]) -> Column:
    """Files that begin with none of the excluded prefixes; null elements are left out."""
    return F.filter(files, lambda f: f.isNotNull() & ~F.exists(F.lit(excluded) if excluded else F.array().cast("array<string>"), lambda p: F.startswith(f, p)))


def test_files(files: Column) -> Column:
    return F.filter(files, lambda f: F.contains(F.lower(f), F.lit("test")))


def labelled(text: Column, label: str) -> Column:
    """Values of lines 'label: value' (bullets allowed), distinct without case."""
    return ordered_distinct_ci(F.regexp_extract_all(text, F.lit(rf"(?im)^[ \t]*[-*]?[ \t]*\Q{label}\E[ \t]*:[ \t]*(\S[^\n]*?)[ \t\r]*$"), 1))


# Patterns of what a text names, by kind, in the order in which they are looked for.
NAMED = {
    "symbol": (r"`([A-Z][a-zA-Z0-9_]+)`", r"class\s+([A-Z][a-zA-Z0-9_]+)", r"def\s+([a-z][a-zA-Z0-9_]+)"),
    "file_path": (r"`([a-z_/]+\.py)`", r"((?:src|tests|lib)/[a-z_/]+\.py)"),
    "config_key": (r"`([a-z_][a-zA-Z0-9_]*)`",),
    "ast_pattern": (r"(?:class|function)\s+(\w+)",),
    "test_case": (r"(?:def |test_)([a-z_][a-zA-Z0-9_]*)",),
}


def named(text: Column, kind: str) -> Column:
    """What a text names, in the order of the patterns; patterns and test cases as often as they occur, the others once.

    Config keys that are symbols aren't counted, nor test cases without the word test in their name.
    """
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in NAMED[kind]))
    if kind == "ast_pattern":
        return found
    if kind == "test_case":
        return F.filter(found, lambda x: F.contains(F.lower(x), F.lit("test")))
    once = ordered_distinct(found)
    return F.array_except(once, named(text, "symbol")) if kind == "config_key" else once


def facts(docs: DataFrame, doc_id: str, text: str, most: int = 5) -> DataFrame:
    """(doc_id, locator_type, locator): the first ``most`` of each kind that texts of 20 characters or more name."""
    long = docs.filter(F.length(F.trim(text)) >= 20)
    kinds = F.array(*(F.struct(F.lit(k).alias("locator_type"), F.slice(named(F.col(text), k), 1, most).alias("v")) for k in NAMED))
    return long.select(doc_id, F.explode(kinds).alias("k")).select(doc_id, "k.locator_type", F.explode("k.v").alias("locator"))


def python_symbols(source: str | None) -> list[tuple[str, str, int]]:
    """(kind, name, line): classes, public methods and public top-level functions; of code that doesn't parse, none."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and not node.name.startswith("_"):
            out.append(("function", node.name, node.lineno))
        elif isinstance(node, ast.ClassDef):
            out.append(("class", node.name, node.lineno))
            out += [("method", f"{node.name}.{m.name}", m.lineno) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and not m.name.startswith("_")]
    return out


def symbol_table(files: DataFrame, path: str, source: str) -> DataFrame:
    """(path, kind, name, line) of Python sources; parsing needs Python, in Arrow batches."""

    @F.pandas_udf("array<struct<kind: string, name: string, line: int>>")
    def parsed(s: pd.Series) -> pd.Series:
        return s.map(python_symbols)

    return files.select(path, F.inline(parsed(source)))


def symbol_summary(table: DataFrame, path: str) -> DataFrame:
    """(path, classes, first_classes, functions): methods don't count as functions."""
    cls, fn = F.col("kind") == "class", F.col("kind") == "function"
    g = table.groupBy(path).agg(F.count_if(cls).alias("classes"), F.array_sort(F.collect_list(F.when(cls, F.struct("line", "name")))).alias("_c"), F.count_if(fn).alias("functions"))
    return g.select(path, "classes", F.slice(F.transform("_c", lambda x: x["name"]), 1, 5).alias("first_classes"), "functions")
