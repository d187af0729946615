"""Records whose schema drifts from file to file: one consistent table, nothing lost, every change reported.

Rescue-column ingestion. ``ingest`` reads each payload once and enforces a target schema: what fits goes to typed columns,
what is unknown or doesn't fit is rescued with its JSON text as written, and ``_fields`` keeps which fields the record had
and of which kind. ``enforce`` is that table with the rescued fields as one JSON object, ``replay`` promotes approved fields
out of it into typed columns later on, and ``changes`` reports from the table what each file adds, removes, renames or
retypes against the one before it in its stream.
"""

from __future__ import annotations

import json
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataforge.operators.windows import neighbours
from strataforge.session import shared_dir

ENTRY = "struct<path: string, kind: string, value: string, same: string>"
#: A rename needs that many contexts with a value, all of them equal before and after.
MIN_SAME = 3
#: Files of a stream, by number, whose neighbours are looked up in one task.
FILES = 1_000

#: Target schema of the repo context summary: column, path, type.
SUMMARY = [
    ("bootstrap_status", "summary.bootstrap_status", "string"),
    ("hint_count", "summary.hint_count", "bigint"),
    ("docs", "summary.source_counts.docs", "bigint"),
    ("codebase_map", "summary.source_counts.codebase_map", "bigint"),
    ("used_cached_context", "summary.used_cached_context", "boolean"),
    ("degraded_reasons", "summary.degraded_reasons", "array<string>"),
    ("bypass_reason", "summary.bypass_reason", "string"),
    ("fingerprint", "summary.fingerprint", "string"),
]


def _no_constant(name: str):
    raise ValueError(name)


class _Number(float):
    """A number that keeps how it was written."""

    __slots__ = ("text",)

    def __new__(cls, text: str):
        x = super().__new__(cls, text)
        x.text = text
        return x


def _whole(text: str):
    return int(text) if len(text) < 4000 and text != "-0" else _Number(text)


def _kind(v) -> str:
    """string, number, boolean, object, or array<...> with the sorted set of element types; '' where there is none."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, dict):
        return "object"
    inner = sorted({"array" if isinstance(x, list) else _kind(x) for x in v if x is not None})
    return f"array<{'|'.join(inner)}>" if inner else ""


def _text(v, exact: bool = True) -> str:
    """A value as JSON: exactly as its numbers were written, or (not exact) with equal numbers written alike and keys sorted."""
    if isinstance(v, str):
        return encode_basestring(v)
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, _Number):
        return v.text if exact else str(int(v)) if v == v // 1 and abs(v) < 2**63 else float.__repr__(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, list):
        return "[" + ",".join([_text(x, exact) for x in v]) + "]"
    return "{" + ",".join([f"{encode_basestring(k)}:{_text(v[k], exact)}" for k in (v if exact else sorted(v))]) + "}"


def _same(v) -> str | None:
    """What is equal for equal values of one kind. Strings as they are, lists of strings so that SQL can write them too."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, list) and all(x is None or isinstance(x, str) for x in v):
        return "\x1f".join(["n" if x is None else "s" + x for x in v])
    return _text(v, False)


def parsed(payload: str | None) -> dict | None:
    """A payload that is a JSON object; None for all else."""
    if payload is None:
        return None
    try:
        top = json.loads(payload, parse_constant=_no_constant, parse_float=_Number, parse_int=_whole)
    except (ValueError, RecursionError):
        return None
    return top if isinstance(top, dict) else None


def members(top: dict, root: str) -> list[tuple[str, object]]:
    """(path, value) of the members under ``root`` that aren't objects. A dot in a name isn't told from one between names."""
    out, todo = [], [(root, top[root])] if isinstance(top.get(root), dict) else []
    while todo:
        at, obj = todo.pop()
        for k, v in obj.items():
            if isinstance(v, dict):
                todo.append((f"{at}.{k}", v))
            else:
                out.append((f"{at}.{k}", v))
    return out


def _entries(rows: list[list[tuple[str, object]] | None]) -> pa.Array:
    """Lists of (path, value) as array<ENTRY>."""
    offsets, path, kind, value, same = [0], [], [], [], []
    for r in rows:
        for p, v in r or ():
            path.append(p)
            kind.append(_kind(v))
            value.append(None if v is None else _text(v))
            same.append(_same(v))
        offsets.append(len(path))
    s = pa.string()
    fields = pa.StructArray.from_arrays([pa.array(path, s), pa.array(kind, s), pa.array(value, s), pa.array(same, s)], ["path", "kind", "value", "same"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields, mask=pa.array([r is None for r in rows], pa.bool_()))


def _reader(root: str, paths: list[str], rest: bool):
    @F.arrow_udf(f"struct<l: array<{ENTRY}>, at: array<int>, rest: string>")
    def read(payloads: pa.Array) -> pa.Array:
        tops = [parsed(x) for x in payloads.to_pylist()]
        found = [None if t is None else members(t, root) for t in tops]
        at = []
        for r in found:
            first = {p: len(r) - 1 - i for i, (p, _) in enumerate(reversed(r))} if r else {}
            at.append([first.get(p, -1) for p in paths])
        others = [{k: v for k, v in t.items() if k != root or not isinstance(v, dict)} if rest and t else None for t in tops]
        kept = [_text(o) if o else None for o in others]
        return pa.StructArray.from_arrays([_entries(found), pa.array(at, pa.list_(pa.int32())), pa.array(kept, pa.string())], ["l", "at", "rest"])

    return read


def _cast(e: Column, to: str) -> Column:
    """An entry's value as the target type, or null where it doesn't fit without loss."""
    kind, same, value = e["kind"], e["same"], e["value"]
    if to == "string":
        return F.when(kind == "string", same)
    if to == "bigint":
        return F.when((kind == "string") & same.rlike(r"^(0|-?[1-9]\d{0,18})$"), same.try_cast("bigint")).when((kind == "number") & value.rlike(r"^(0|-?[1-9]\d{0,18})$"), value.try_cast("bigint"))
    if to == "double":
        return F.when(kind.isin("number", "string"), F.trim(same).try_cast("double"))
    if to == "boolean":
        return F.when(kind.isin("boolean", "string") & same.isin("true", "false"), same == "true")
    if to == "array<string>":
        return F.when((kind == "array<string>") | (value.startswith("[") & (kind == "")), F.from_json(value, "array<string>"))
    raise ValueError(f"no rule for {to}")


def _written(c: str, to: str) -> Column:
    """What ``_same`` gives for the value of a typed column."""
    if to == "array<string>":
        return F.array_join(F.transform(c, lambda x: F.coalesce(F.concat(F.lit("s"), x), F.lit("n"))), "\x1f")
    return F.col(c).cast("string")


def ingest(records: DataFrame, keys: list[str], payload: str = "payload", root: str = "summary", schema=None, rest: bool = True) -> DataFrame:
    """keys, the target columns, ``_fields``, ``_kinds``, ``_kept``, ``_rest``, ``_raw`` and ``_status``.

    ``_fields`` is an array of (path, kind) of all fields under ``root``, nulls included (kind ''); null for a payload that
    isn't a JSON object. ``_kinds`` are the kinds that the values of the typed columns had. ``_kept`` has the entries of all that is unknown or doesn't fit, ``_rest`` the members of the
    payload outside ``root`` as JSON, ``_raw`` a payload that is no JSON object. Of a path that a record has twice (a dot in
    a name) the first is looked at, the other is kept. ``_status`` is ok, rescued or corrupt.
    """
    schema = SUMMARY if schema is None else schema
    step = lambda df, *columns: df.select("*", F.inline(F.array(F.struct(*columns))))  # noqa: E731  a border: each column is worked out once
    rows = records.select(*keys, F.col(payload).cast("string").alias("_p"))
    rows = rows.select("*", F.inline(F.array(_reader(root, [p for _, p, _ in schema], rest)("_p"))))
    place = lambda i: F.get("at", F.lit(i))
    rows = step(rows, F.transform("at", lambda i: F.when(i >= 0, F.get("l", i))).alias("_e"))
    entry = lambda i: F.get("_e", F.lit(i))
    rows = step(rows, *(_cast(entry(i), t).alias(c) for i, (c, _, t) in enumerate(schema)))
    fits = F.array(*(F.when(F.col(c).isNotNull(), place(i)).otherwise(-1) for i, (c, _, _) in enumerate(schema)))
    kept = F.filter("l", lambda e, i: e["value"].isNotNull() & ~F.array_contains(fits, i))
    kinds = F.array(*(F.when(F.col(c).isNotNull(), entry(i)["kind"]) for i, (c, _, _) in enumerate(schema)))
    rows = step(rows, kept.alias("_kept"), kinds.alias("_kinds"), F.transform("l", lambda e: F.struct(e["path"].alias("path"), e["kind"].alias("kind"))).alias("_fields"))
    status = F.when(F.col("_fields").isNull(), "corrupt").when(F.size("_kept") > 0, "rescued").otherwise("ok")
    return rows.select(*keys, *(c for c, _, _ in schema), "_fields", "_kinds", "_kept", F.col("rest").alias("_rest"), F.when(F.col("_fields").isNull(), F.col("_p")).alias("_raw"), status.alias("_status"))


def _object(entries: Column) -> Column:
    """Entries as one JSON object, sorted by path; a path that comes again is numbered."""
    ordered = F.array_sort(entries)
    again = lambda e, i: (i > 0) & (F.get(ordered, i - 1)["path"] == e["path"])
    named = F.transform(ordered, lambda e, i: F.concat(F.substring(F.to_json(F.array(F.when(again(e, i), F.concat(e["path"], F.lit("#"), i.cast("string"))).otherwise(e["path"]))), 2, 2**30), F.lit(":"), e["value"]))
    # ["path"] without its brackets keeps the escaping of the JSON writer
    parts = F.transform(named, lambda x: F.regexp_replace(x, r'(?s)^("(?:[^"\\]|\\.)*")\]:', "$1:"))
    return F.when(F.size(entries) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def enforce(records: DataFrame, keys: list[str], payload: str = "payload", root: str = "summary", schema=None) -> DataFrame:
    """keys, the target columns, ``_rescued``, ``_rest`` and ``_status``.

    ``_rescued`` is a JSON object path -> value of every unknown field and every value that doesn't fit, or null, with
    numbers as they were written; a corrupt payload is itself kept under the path ''. ``_rest`` has the members outside
    ``root``. Null payloads are corrupt with nothing to keep. Fields absent from a record are null.
    """
    schema = SUMMARY if schema is None else schema
    rows = ingest(records, keys, payload, root, schema)
    rescued = F.when(F.col("_status") == "corrupt", F.when(F.col("_raw").isNotNull(), F.to_json(F.create_map(F.lit(""), F.col("_raw"))))).otherwise(_object(F.col("_kept")))
    return rows.select(*keys, *(c for c, _, _ in schema), rescued.alias("_rescued"), "_rest", "_status")


def _at(path: str):
    return lambda e: e["path"] == path


def replay(table: DataFrame, approved: list[tuple[str, str, str]]) -> DataFrame:
    """The table with approved (column, path, type) fields filled from ``_rescued`` and removed there.

    An existing column keeps its value and is filled only where it is null, so a renamed field can be promoted into
    the column of its old name; other columns are added. Values that don't fit stay rescued.
    """

    @F.arrow_udf(f"array<{ENTRY}>")
    def entries(s: pa.Array) -> pa.Array:
        return _entries([None if x is None else list(parsed(x).items()) for x in s.to_pylist()])

    rows = table.withColumn("_e", F.when(F.col("_status") == "rescued", entries(F.when(F.col("_status") == "rescued", F.col("_rescued")))))
    promoted = []
    for column, path, to in approved:
        hit = F.get(F.filter("_e", _at(path)), F.lit(0))
        free = F.col(column).isNull() if column in rows.columns else F.lit(True)
        name = f"_hit_{len(promoted)}"
        rows = rows.withColumn(name, F.when(free, _cast(hit, to)))
        rows = rows.withColumn(column, F.coalesce(F.col(column), F.col(name)) if column in rows.columns else F.col(name))
        promoted.append((path, name))
    used = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.lit(p)) for p, n in promoted), F.lit(None).cast("string")))
    rest = F.filter("_e", lambda e: ~F.array_contains(used, e["path"]))
    rescued = F.when(F.col("_status") == "rescued", _object(rest)).otherwise(F.col("_rescued"))
    status = F.when((F.col("_status") == "rescued") & (F.size(rest) == 0), "ok").otherwise(F.col("_status"))
    rows = rows.withColumn("_rescued_new", rescued).withColumn("_status_new", status)
    out = [c for c in rows.columns if not c.startswith(("_e", "_hit_", "_rescued", "_status"))]
    return rows.select(*out, F.col("_rescued_new").alias("_rescued"), F.col("_status_new").alias("_status"))


def changes(table: DataFrame, stream: str = "stream_id", seq: str = "file_seq", key: str = "context_key", tie: str = "record_id", schema=None) -> DataFrame:
    """(stream, seq, change_kind, field_path, old_path) of each file against the one before it in its stream.

    table is that of ``ingest``: presence and kinds come from ``_fields``, values from the typed columns and from
    what was rescued. Records without a stream or a file number and corrupt ones don't count. Of several records of one key in a file
    the first by ``tie`` gives the values that renames are judged by. A field that fits several renames is paired once, in
    the order of the paths. Records are aggregated by file and field before they move; only files with a new and a gone
    field have values compared. Along a stream there is one row per file and field.
    """
    schema = SUMMARY if schema is None else schema
    value = lambda p, k, s: F.struct(p.alias("path"), k.alias("kind"), s.alias("same"))
    typed = [F.when(F.col(c).isNotNull(), value(F.lit(p), F.get("_kinds", F.lit(i)), _written(c, t))) for i, (c, p, t) in enumerate(schema)]
    values = F.concat(F.array_compact(F.array(*typed)), F.transform("_kept", lambda e: value(e["path"], e["kind"], e["same"])))
    shared_dir(table.sparkSession)
    rows = (
        table.filter(F.col(stream).isNotNull() & F.col(seq).isNotNull() & F.col("_fields").isNotNull())
        .select(F.col(stream).alias("s"), F.col(seq).alias("q"), F.col(key).alias("key"), F.col(tie).alias("tie"), F.col("_fields").alias("f"), values.alias("v"))
        .checkpoint()  # payloads are parsed once
    )
    files = neighbours(rows.select("s", "q").distinct(), ["s"], "q", F.floor(F.col("q") / FILES))
    fields = rows.select("s", "q", F.inline("f")).groupBy("s", "q", "path").agg(F.array_sort(F.array_remove(F.collect_set("kind"), "")).alias("kinds"))  # kinds are few

    # each field in its file and in the one after it, side by side
    here = F.struct(F.col("q"), F.lit(True).alias("now"), "kinds", F.col("before").isNull().alias("first"))
    after = F.struct(F.col("after").alias("q"), F.lit(False).alias("now"), F.lit(None).cast("array<string>").alias("kinds"), F.lit(False).alias("first"))
    sides = fields.join(files, ["s", "q"]).select("s", "path", F.inline(F.array(here, after))).filter("q is not null")
    sides = sides.groupBy("s", "q", "path").agg(F.bool_or("now").alias("new"), F.bool_or(~F.col("now")).alias("old"), F.max("kinds").alias("kinds"), F.bool_or("first").alias("first")).checkpoint()
    moved = sides.filter("new <> old and not first").select("s", "q", "path", "new")

    # types against the latest typed file since the path last came new
    run = F.sum((~F.col("old")).cast("int")).over(W.partitionBy("s", "path").orderBy("q"))
    before = F.last(F.when(F.size("kinds") > 0, F.col("kinds")), ignorenulls=True).over(W.partitionBy("s", "path", "run").orderBy("q").rowsBetween(W.unboundedPreceding, -1))
    retyped = sides.filter("new").withColumn("run", run).withColumn("before", before).filter((F.size("kinds") > 0) & (F.col("kinds") != F.col("before")))

    # values of the contexts that both files of a pair have, for its new and gone fields
    paths = lambda new: F.collect_set(F.when(F.col("new") == new, F.col("path")))  # noqa: E731, of one file
    pairs = moved.groupBy("s", F.col("q").alias("to")).agg(paths(True).alias("fresh"), paths(False).alias("gone")).filter((F.size("fresh") > 0) & (F.size("gone") > 0))
    pairs = pairs.join(files.select("s", F.col("q").alias("to"), F.col("before").alias("from")), ["s", "to"])
    ends = F.array(F.struct(F.col("to").alias("q"), F.lit(True).alias("now"), F.col("fresh").alias("paths")), F.struct(F.col("from").alias("q"), F.lit(False).alias("now"), F.col("gone").alias("paths")))
    asked = rows.filter(F.col("key").isNotNull()).join(pairs.select("s", "to", F.inline(ends)), ["s", "q"])
    one = F.struct("tie", F.filter("v", lambda e: F.array_contains("paths", e["path"])).alias("v"))
    kept = asked.groupBy("s", "to", "key").agg(F.min(F.when(F.col("now"), one)).alias("a"), F.min(F.when(~F.col("now"), one)).alias("b")).filter("a is not null and b is not null")
    side = lambda c, now: F.transform(F.col(c)["v"], lambda e: F.struct(F.lit(now).alias("now"), e["path"].alias("path"), e["kind"].alias("kind"), e["same"].alias("same")))
    each = kept.select("s", "to", "key", F.inline(F.concat(side("a", True), side("b", False))))
    prints = each.groupBy("s", "to", "now", "path").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("key", "kind", "same")).alias("x"), F.sum(F.hash("same", "key", "kind").cast("bigint")).alias("h")
    ).filter(F.col("n") >= MIN_SAME)
    listed = lambda now: F.array_sort(F.collect_list(F.when(F.col("now") == now, F.col("path"))))
    alike = prints.groupBy("s", "to", "n", "x", "h").agg(listed(True).alias("new"), listed(False).alias("old"))
    zipped = F.filter(F.arrays_zip("new", "old"), lambda z: z["new"].isNotNull() & z["old"].isNotNull())
    renamed = alike.select("s", F.col("to").alias("q"), F.inline(zipped)).checkpoint()

    report = lambda df, kind, path, old: df.select("s", "q", F.lit(kind).alias("change_kind") if isinstance(kind, str) else kind.alias("change_kind"), F.col(path).alias("field_path"), old.alias("old_path"))
    taken = renamed.select("s", "q", F.explode(F.array("new", "old")).alias("path"))
    plain = moved.join(taken, ["s", "q", "path"], "left_anti")
    every = report(plain, F.when(F.col("new"), "added").otherwise("removed"), "path", F.lit("")).unionByName(report(renamed, "renamed", "new", F.col("old"))).unionByName(report(retyped, "retyped", "path", F.lit("")))
    return every.select(F.col("s").alias(stream), F.col("q").alias(seq), "change_kind", "field_path", "old_path")


def record_changes(records: DataFrame, stream: str = "stream_id", seq: str = "file_seq", key: str = "context_key", tie: str = "record_id", payload: str = "payload", root: str = "summary", schema=None) -> DataFrame:
    """``changes`` of the table that ``ingest`` makes of records."""
    return changes(ingest(records, [stream, seq, key, tie], payload, root, schema, rest=False), stream, seq, key, tie, schema)
