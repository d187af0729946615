"""Checks as columns: an array of messages per row (empty: valid), or the first failure only. No row ends a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.text import nonblank

# Allowed values of the fields that are checked.
OPS = ("feat", "bugfix", "refactor", "optimize", "cleanup", "config", "docs", "test", "compat", "safety", "other")
IMPORTANCE = ("primary", "secondary")
FACT_TYPES = ("module_role", "dependency_rule", "convention", "pattern_usage", "invariant", "hotspot_signal")
LOCATORS = ("file_path", "symbol", "config_key", "section_ref", "test_case", "ast_pattern")
DEVELOPMENT = ("feature", "bugfix", "refactor", "migration", "optimize")


def messages(*checks: tuple[Column, str | Column]) -> Column:
    """Messages of the checks that fail, in order; a check whose condition is null doesn't fail."""
    return F.array_compact(F.array(*(F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in checks)))


def first_failure(*checks: tuple[Column, str | Column]) -> Column:
    """Message of the first check that fails, or null."""
    return F.coalesce(*(F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in checks), F.lit(None).cast("string"))


def unit_errors() -> Column:
    """Errors of a change unit: required texts, enums by exact spelling, paths."""
    return messages(
        (~nonblank(F.col("commit_id")), "missing commit_id"),
        (~nonblank(F.col("theme")), "missing theme"),
        (~nonblank(F.col("summary")), "missing summary"),
        (~F.coalesce(F.col("op"), F.lit("")).isin(*OPS), F.concat(F.lit("invalid op: "), F.coalesce("op", F.lit("null")))),
        (~F.coalesce(F.col("importance"), F.lit("")).isin(*IMPORTANCE), F.concat(F.lit("invalid importance: "), F.coalesce("importance", F.lit("null")))),
        (F.coalesce(F.size("file_paths"), F.lit(0)) <= 0, "no file_paths"),
    )


def fact_error() -> Column:
    """First structural failure of a fact row with an evidence array, or null."""
    bad = F.filter("evidence", lambda e: ~F.coalesce(e["locator_type"], F.lit("")).isin(*LOCATORS))
    return first_failure(
        (F.col("fact_id").isNull() | F.col("fact_type").isNull() | F.col("statement").isNull() | F.col("source").isNull() | F.col("evidence").isNull(), "missing fields"),
        (~F.col("fact_type").isin(*FACT_TYPES), F.concat(F.lit("invalid fact_type: "), F.col("fact_type"))),
        (F.size(bad) > 0, F.concat(F.lit("invalid locator_type: "), F.coalesce(F.get(bad, F.lit(0))["locator_type"], F.lit("null")))),
        (F.exists("evidence", lambda e: e["locator"].isNull()), "missing locator"),
    )


def with_json(rows: DataFrame, payload: Column, name: str = "json") -> DataFrame:
    """rows with a JSON text as a variant (null where it is none), parsed once however often it is looked into."""
    return rows.select("*", F.inline(F.array(F.struct(F.try_parse_json(payload).alias(name)))))


def kind_at(v: Column, path: str = "$") -> Column:
    """STRING, BIGINT, BOOLEAN, ARRAY, OBJECT, ... of a member of a variant; null if it is absent, VOID for a JSON null."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), r"^(\w+)", 1)


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(kind_at(v, path) == kind, F.lit(False))


def _filled(v: Column, path: str) -> Column:
    return _is(v, path, "STRING") & nonblank(F.try_variant_get(v, path, "string"))


# The objects of a demand card with their fields; those of the second part are lists of texts.
CARD_TEXTS, CARD_LISTS = {"request_source": ("issue_id", "issue_text")}, {"mapping": ("domains", "concepts", "rules", "invariants"), "uncertainties": ("open_questions",)}


def card_errors(v: Column) -> Column:
    """Errors of a demand card given as a variant, as an array: unknown fields, objects and texts that are missing, list elements by
    their index, the development type. What is no object, or has no card, gives that one error."""
    root = "$.demand_card"
    prefixed = lambda arr, pre, post: F.transform(arr, lambda x: F.concat(F.lit(pre), x.cast("string"), F.lit(post)))
    none = F.array().cast("array<string>")

    def unknown(path: str, known: tuple[str, ...]) -> Column:
        text = F.to_json(F.try_variant_get(v, path, "variant"))
        extra = F.when(_is(v, path, "OBJECT"), F.array_sort(F.array_except(F.json_object_keys(text), F.lit(list(known)))))
        return F.coalesce(prefixed(extra, path[2:] + "." if path != "$" else "", ": unknown field"), none)

    parts = [unknown("$", ("demand_card",)), unknown(root, ("development_type", *CARD_TEXTS, *CARD_LISTS))]
    for obj, names in (CARD_TEXTS | CARD_LISTS).items():
        at = f"{root}.{obj}"
        parts += [F.when(~_is(v, at, "OBJECT"), F.array(F.lit(f"{at[2:]}: object expected"))).otherwise(none), unknown(at, names)]
        for n in names:
            if obj in CARD_TEXTS:
                parts.append(F.when(_is(v, at, "OBJECT") & ~_filled(v, f"{at}.{n}"), F.array(F.lit(f"{at[2:]}.{n}: text expected"))).otherwise(none))
                continue
            elements = F.try_variant_get(v, f"{at}.{n}", "array<variant>")
            bad = F.filter(F.transform(elements, lambda e, i: F.when(~F.coalesce((kind_at(e) == "STRING") & nonblank(F.try_variant_get(e, "$", "string")), F.lit(False)), i)), lambda i: i.isNotNull())
            no_list = F.when(_is(v, at, "OBJECT"), F.array(F.lit(f"{at[2:]}.{n}: list expected"))).otherwise(none)
            parts.append(F.when(_is(v, f"{at}.{n}", "ARRAY"), F.coalesce(prefixed(bad, f"{at[2:]}.{n}[", "]: text expected"), none)).otherwise(no_list))
    kind = F.try_variant_get(v, f"{root}.development_type", "string")
    parts.append(F.when(~F.coalesce(_is(v, f"{root}.development_type", "STRING") & kind.isin(*DEVELOPMENT), F.lit(False)), F.array(F.lit("demand_card.development_type: not an allowed value"))).otherwise(none))
    found = F.flatten(F.array(*parts))
    return F.when(~_is(v, "$", "OBJECT"), F.array(F.lit("object expected"))).when(~_is(v, root, "OBJECT"), F.array(F.lit("demand_card: object expected"))).otherwise(found)


# Categories of signals, and the keys that each signal needs.
SIGNAL_CATEGORIES, SIGNAL_KEYS = ("domain_signals", "concept_signals", "rule_signals", "demand_pattern_signals"), ("confidence", "evidence", "signal_type", "source")


def signal_errors(v: Column) -> Column:
    """Errors of a signal document given as a variant: categories that are no list, entries that are no object or lack keys.
    Categories may be absent; null and what is no object give one error."""
    none = F.array().cast("array<string>")
    parts = []
    for c in SIGNAL_CATEGORIES:
        entries = F.try_variant_get(v, f"$.{c}", "array<variant>")

        def fault(e, i, c=c):
            lacking = F.array_except(F.lit(list(SIGNAL_KEYS)), F.coalesce(F.json_object_keys(F.to_json(e)), none))
            what = F.when(~F.coalesce(kind_at(e) == "OBJECT", F.lit(False)), ": object expected").when(F.size(lacking) > 0, F.concat(F.lit(": lacks "), F.array_join(lacking, ", ")))
            return F.concat(F.lit(f"{c}["), i.cast("string"), F.lit("]"), what)

        faults = F.filter(_indexed(entries, fault), lambda x: x.isNotNull())
        parts.append(F.when(kind_at(v, f"$.{c}").isNull(), none).when(_is(v, f"$.{c}", "ARRAY"), F.coalesce(faults, none)).otherwise(F.array(F.lit(f"{c}: list expected"))))
    return F.when(v.isNull(), F.array(F.lit("no document"))).when(~_is(v, "$", "OBJECT"), F.array(F.lit("object expected"))).otherwise(F.flatten(F.array(*parts)))


def _indexed(arr: Column, f) -> Column:
    return F.transform(arr, lambda e, i: f(e, i))


# The fields of a case with their kinds, the texts that each kind of development begins with, and wordings that
# hold for any software.
CASE_FIELDS = {
    "case_id": None, "commit_id": None, "module": None, "commit_log": "STRING", "issue_text": "STRING", "development_type": "STRING", "rules": "ARRAY", "invariants": "ARRAY",
    "split_suggestion": None, "value": "STRING", "split_suggestion.needs_split": "BOOLEAN", "split_suggestion.split_reasons": "ARRAY",
}
CASE_PREFIXES = {"feature": "feat：", "bugfix": "bugfix：", "refactor": "refactor：", "migration": "migration：", "optimize": "optimize："}
CASE_VALUES = ("high", "medium", "low")
CASE_GENERIC = (
    "null check", "bounds check", "exception handling", "input validation", "avoid crash", "thread-safety", "code style", "defensive programming",
    "空值判断", "空值检查", "空指针", "边界检查", "异常处理", "输入校验", "输入验证", "避免崩溃", "线程安全", "代码规范", "代码风格", "防御性编程", "做好异常", "避免出错", "保证稳定", "确保安全",
)


def case_failure(v: Column) -> Column:
    """The first failure of a case given as a variant, or null: absent fields, then kinds, allowed values, and what must agree."""
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    begins = lambda c, ps: F.array_contains(F.transform(F.lit(list(ps)), lambda p: F.startswith(c, p)), True)
    items = F.transform(F.concat(*(F.coalesce(F.try_variant_get(v, f"$.{n}", "array<variant>"), F.array().cast("array<variant>")) for n in ("rules", "invariants"))), lambda e: F.try_variant_get(e, "$", "string"))
    generic = F.filter(items, lambda x: F.exists(F.lit(list(CASE_GENERIC)), lambda g: F.contains(F.lower(x), g)))
    wanted = F.create_map(*(F.lit(x) for kv in CASE_PREFIXES.items() for x in kv))[text("development_type")]
    reasons = F.size(F.try_variant_get(v, "$.split_suggestion.split_reasons", "array<variant>"))
    return first_failure(
        (~_is(v, "$", "OBJECT"), "object expected"),
        *((kind_at(v, f"$.{n}").isNull(), f"{n}: missing") for n in CASE_FIELDS),
        *((~_is(v, f"$.{n}", k), f"{n}: {k.lower()} expected") for n, k in CASE_FIELDS.items() if k),
        (~text("development_type").isin(*CASE_PREFIXES), F.concat(F.lit("development_type: unknown value "), text("development_type"))),
        (~text("value").isin(*CASE_VALUES), F.concat(F.lit("value: unknown value "), text("value"))),
        (~F.startswith(text("issue_text"), wanted), F.concat(F.lit("issue_text: must begin with "), wanted)),
        (~F.try_variant_get(v, "$.split_suggestion.needs_split", "boolean") & (reasons > 0), "split_suggestion: reasons without a split"),
        (begins(text("commit_log"), CASE_PREFIXES.values()), "commit_log: begins like an issue"),
        (F.size(generic) > 0, F.concat(F.lit("holds for any software: "), F.get(generic, F.lit(0)))),
    )


def section_errors(text: Column, required: tuple[str, ...], mentions: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Errors of a text whose level-two sections must be there, be filled, and hold more than blank lines and headings.

    mentions: what the text of a section must contain, ignoring case. Of sections with one title the last counts. A null or
    blank text gives one error.
    """
    lines = F.split(text, r"\r?\n")
    titles = F.transform(lines, lambda x: F.regexp_extract(F.trim(x), r"^##\s+(.+?)\s*$", 1))
    heads = F.filter(F.transform(titles, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda h: h["t"] != "")
    errors = []
    for name in required:
        at = F.array_max(F.transform(_named(heads, name), lambda h: h["i"]))
        upto = F.coalesce(F.array_min(_after(heads, at)), F.size(lines))
        body = F.slice(lines, at + 2, upto - at - 1)
        filled = F.exists(body, lambda x: F.trim(x) != "")
        useful = F.exists(body, lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))
        errors += [F.when(at.isNull(), f"{name}: missing").when(~filled, f"{name}: empty").when(~useful, f"{name}: nothing but headings")]
        low = F.lower(F.array_join(body, "\n"))
        errors += [F.when(at.isNotNull() & ~F.contains(low, F.lit(m.lower())), f"{name}: no {m}") for m in (mentions or {}).get(name, ())]
    return F.when(~nonblank(text), F.array(F.lit("empty text"))).otherwise(F.array_compact(F.array(*errors)))


def _named(heads: Column, name: str) -> Column:
    return F.filter(heads, lambda h: h["t"] == name)


def _after(heads: Column, at: Column) -> Column:
    return F.transform(F.filter(heads, lambda h: h["i"] > at), lambda h: h["i"])


def unknown_fields(payload: Column, known: list[str]) -> Column:
    """Top-level fields of a JSON object that aren't known; null if it is none."""
    return F.array_sort(F.array_except(F.json_object_keys(payload), F.lit(known)))


def heading(text: Column, title: Column | str) -> Column:
    """The text has the level-two heading, ignoring case, as whole words."""
    t = F.lit(title) if isinstance(title, str) else title
    return F.regexp_like(text, F.concat(F.lit(r"(?im)^##\s+\Q"), t, F.lit(r"\E(?![\p{L}\p{N}_])")))


def missing_headings(text: Column, required: tuple[str, ...]) -> Column:
    """Required headings that the text lacks, in their order; all of them for a null or empty text."""
    return F.filter(F.lit(list(required)), lambda r: ~F.coalesce(heading(text, r), F.lit(False)))


def any_heading(text: Column, options: tuple[str, ...]) -> Column:
    return F.exists(F.lit(list(options)), lambda r: F.coalesce(heading(text, r), F.lit(False)))


def lacks_keyword(text: Column, keyword: str) -> Column:
    return ~F.coalesce(F.contains(F.lower(text), F.lit(keyword.lower())), F.lit(False))


def acceptance(text: Column) -> Column:
    """Some line is 'acceptance: true', blanks and case aside."""
    return F.coalesce(F.exists(F.split(text, "\n"), lambda x: F.lower(F.trim(x)) == "acceptance: true"), F.lit(False))


def consistent_scores(priority: Column, *scores: Column) -> Column:
    """Errors of a scored row: the priority must be the largest score, each from 1 to 10."""
    return messages((priority != F.greatest(*scores), "priority must be the largest score"), *((~s.between(1.0, 10.0), "score out of range") for s in scores))


def cross_field_errors(action: Column, merge_target: Column, needs_check: Column, gap: Column) -> Column:
    """Errors of a decision: a merge needs a target, a check needs a gap."""
    return messages(((action == "merge") & ~nonblank(merge_target), "merge without a target"), (needs_check & ~nonblank(gap), "check without a gap"))


def issue_error(text: Column) -> Column:
    """What is wrong with the text of an issue, or null."""
    return F.when(~nonblank(text), F.lit("empty issue"))


def stable(capability_id: Column, refs: Column, confidence: Column) -> Column:
    """Backed by enough references: two for high or medium confidence, one for low."""
    n = F.coalesce(F.size(refs), F.lit(0))
    return nonblank(capability_id) & (n >= F.when(F.coalesce(confidence, F.lit("low")).isin("high", "medium"), 2).otherwise(1))
