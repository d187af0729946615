"""Stable ids, digests, scores and rule-based labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataforge.functions.text import word_pattern


def stable_id(kind: str, name: Column, prefix: str = "") -> Column:
    """prefix + kind_ + the first 12 hex digits of SHA-256 of kind:name."""
    return F.concat(F.lit(f"{prefix}{kind}_"), F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), name), 256), 1, 12))


def digest(*parts: Column, digits: int = 64) -> Column:
    """SHA-256 of the parts as JSON, so that their borders and nulls count."""
    return F.substring(F.sha2(F.to_json(F.struct(*(p.alias(f"c{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256), 1, digits)


def document_set_digest(paths_and_texts: Column) -> Column:
    """Digest of a set of (path, text) structs, whatever their order."""
    each = F.array_sort(F.transform(paths_and_texts, lambda x: F.concat(x["path"], F.lit("="), F.sha2(x["text"], 256))))
    return F.sha2(F.array_join(each, "\n"), 256)


# Base score by confidence, and bonuses with their most.
BASE = {"high": 8.0, "medium": 6.0, "low": 3.0}


def scores(confidence: Column, evidence: Column, signals: Column) -> tuple[Column, Column]:
    """(business, value): the base of the confidence, half a point per evidence (2 at most), 0.3 per signal (1 at most)."""
    base = F.when(confidence == "high", BASE["high"]).when(confidence == "medium", BASE["medium"]).otherwise(BASE["low"])
    n = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return (
        F.round(F.least(base + F.least(n(evidence) * 0.5, F.lit(2.0)), F.lit(10.0)), 1),
        F.round(F.least(base + F.least(n(signals) * 0.3, F.lit(1.0)), F.lit(10.0)), 1),
    )


def valid(confidence: Column, evidence: Column, *required: Column) -> Column:
    """pass or fail: nothing required is missing, and the confidence is high, or medium with evidence."""
    absent = F.lit(False)
    for r in required:
        absent = absent | (F.coalesce(r, F.lit("")) == "")
    return F.when(absent, "fail").when(confidence == "high", "pass").when((confidence == "medium") & (evidence > 0), "pass").otherwise("fail")


def validity_reason(confidence: Column, evidence: Column, required: dict[str, Column]) -> Column:
    """Why ``valid`` says so: the required fields that are missing, or what the confidence rests on."""
    absent = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit("")) == "", F.lit(n)) for n, c in required.items())))
    some = F.coalesce(evidence, F.lit(0)) > 0
    backed = F.when(some, "medium confidence, with evidence").otherwise("medium confidence, no evidence")
    return F.when(F.size(absent) > 0, F.concat(F.lit("missing: "), F.array_join(absent, ", "))).when(confidence == "high", "high confidence").when(confidence == "medium", backed).otherwise("low confidence")


def reasons(validity: Column, confidence: Column, evidence: Column, business: Column, value: Column) -> tuple[Column, Column]:
    """(for, against): what speaks for a valid candidate (confidence, evidence, scores of 7 or more), what against another."""
    n = F.coalesce(evidence, F.lit(0))
    passed = validity == "pass"
    compact = lambda *cs: F.array_compact(F.array(*cs))
    yes = compact(F.lit("valid"), F.when(confidence == "high", "high confidence"), F.when(n > 0, F.format_string("%d references", n)), F.when(business >= 7.0, "business score"), F.when(value >= 7.0, "value score"))
    no = compact(F.lit("not valid"), F.when(F.coalesce(confidence, F.lit("low")) == "low", "low confidence"), F.when(n == 0, "no evidence"))
    none = F.array().cast("array<string>")
    return F.when(passed, yes).otherwise(none), F.when(passed, none).otherwise(no)


def evidence_gap(validity: Column, confidence: Column, evidence: Column) -> Column:
    """What is to be verified of a valid candidate, or null: medium confidence on less than two references, high on none."""
    n = F.coalesce(evidence, F.lit(0))
    return F.when((validity == "pass") & (confidence == "medium") & (n < 2), "medium confidence on little evidence").when((validity == "pass") & (confidence == "high") & (n == 0), "high confidence without evidence")


# Words of a rule that make it an invariant.
NORMATIVE = ("must", "always", "never", "required", "cannot", "should not")


def invariants(direct: Column, of_models: Column, rules: Column) -> Column:
    """Stated invariants; else those of models, each once; else the rules with a normative word, each once."""
    strong = F.filter(rules, lambda r: F.exists(F.lit(list(NORMATIVE)), lambda w: F.contains(F.lower(r), w)))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(some(direct), direct).when(some(of_models), F.array_distinct(of_models)).otherwise(F.array_distinct(F.coalesce(strong, F.array().cast("array<string>"))))


def recommended(validity: Column, priority: Column) -> Column:
    return F.when(validity == "fail", "drop").when(priority >= 7.0, "keep").when(priority >= 5.0, "verify_first").otherwise("backlog")


# Words of each kind of development, in the order of their priority.
KINDS = {
    "bugfix": ["bug", "fix", "error", "crash", "regression", "fail", "failure", "failing", "broken"],
    "migration": ["migrate", "migration", "upgrade", "port", "replace", "move to"],
    "refactor": ["refactor", "restructure", "cleanup", "reorganize", "rename"],
    "optimize": ["optimise", "optimize", "performance", "latency", "throughput", "cpu", "memory", "overhead", "faster"],
    "feature": ["add", "introduce", "new", "implement", "support", "create"],
}


# Wordings of what is to be confirmed.
SEVERAL = "Multiple development intents detected (%s); confirm primary type is '%s'."
UNCLEAR = "Issue intent is unclear; confirm whether this is feature, bugfix, refactor, migration, or optimize."


def kinds_of(text: Column) -> Column:
    """Kinds of development that the text has a word of, in priority order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(word_pattern(ws)), F.lit(k)) for k, ws in KINDS.items())))


def development_type(text: Column) -> Column:
    """The first kind by priority; feature if there is none."""
    return F.coalesce(F.get(kinds_of(text), F.lit(0)), F.lit("feature"))


def open_question(text: Column, kinds: Column | None = None) -> Column:
    """What is to be confirmed: several kinds, or none; null for one. kinds: those of the text, where they are known."""
    k = kinds_of(text) if kinds is None else kinds
    many = F.format_string(SEVERAL, F.array_join(F.array_sort(k), ", "), F.get(k, F.lit(0)))
    none = F.lit(UNCLEAR)
    return F.when(F.size(k) > 1, many).when(F.size(k) == 0, none)


# Wordings of each intent, tried in this order.
INTENTS = {
    "status": ["status", "check", "where", "what is"],
    "reset": ["reset", "clear", "start over"],
    "step": ["step", "next", "continue one", "single step"],
    "resume": ["resume", "continue", "proceed", "go on"],
}


def intent(text: Column) -> Column:
    """The first intent of which a wording occurs anywhere in the text; run if none does."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("run")
    for name, ws in reversed(INTENTS.items()):
        hit = F.lit(False)
        for w in ws:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def stat_weight(stat: Column) -> Column:
    """500 per changed binary plus insertions plus deletions of a --stat text."""
    n = lambda p: F.coalesce(F.regexp_extract(stat, p, 1).try_cast("bigint"), F.lit(0))
    line = r"\d+ files? changed"
    binaries = F.size(F.regexp_extract_all(stat, F.lit(r"(Bin \d+ -> \d+ bytes)"), 1)).cast("bigint") * 500
    return F.coalesce(binaries + n(line + r", (\d+) insertions?\(\+\)") + n(line + r"(?:, \d+ insertions?\(\+\))?, (\d+) deletions?\(-\)"), F.lit(0))


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    kb = F.lit(1024.0)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, F.format_string("%.1f KB", n / kb)).when(n < 1024**3, F.format_string("%.1f MB", n / kb / kb)).otherwise(F.format_string("%.1f GB", n / kb / kb / kb))


def module_of(path: Column) -> Column:
    """First path component; root without a slash."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("root")


def month_of(date: Column) -> Column:
    """First seven characters of a date text; unknown if it is shorter or null."""
    return F.when(F.length(date) >= 7, F.substring(date, 1, 7)).otherwise("unknown")


def context_mode(has_object: Column, status: Column, fingerprint_ok: Column, hints: Column) -> Column:
    """How far a repo context can be relied on: full, degraded or bypass, with the reason after a colon."""
    return (
        F.when(~has_object, "bypass:invalid-context").when(~fingerprint_ok, "bypass:stale-context")
        .when(~F.coalesce(status, F.lit("")).isin("full", "degraded", "bypass"), "bypass:invalid-bootstrap-status")
        .when(status == "bypass", "bypass").when(hints == 0, "degraded:empty-shared-hints").when(status == "degraded", "degraded").otherwise("full")
    )


def outcome(action: Column) -> Column:
    """keep and merge are accepted, drop is rejected, backlog deferred, verify_first needs evidence; others are deferred."""
    return F.when(action.isin("keep", "merge"), "accepted").when(action == "drop", "rejected").when(action == "verify_first", "needs_evidence").otherwise("deferred")
