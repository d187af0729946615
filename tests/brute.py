"""Queries that SQL can't express, worked out in plain Python from the same tables: rows as dicts."""

import ast
import hashlib
import json
import re
import unicodedata

from test_drift import brute as drift_changes
from test_timestamps import brute_instants


def rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def p4_found(con):
    found = drift_changes(rows(con, "select record_id, stream_id, file_seq, context_key, payload from context_records"))
    return [dict(zip(("stream_id", "file_seq", "change_kind", "field_path", "old_path"), r)) for r in found]


KEYS = ("record_id", "stream_id", "file_seq", "record_no", "context_key")
TARGET = {
    "bootstrap_status": ("summary.bootstrap_status", str), "hint_count": ("summary.hint_count", int), "docs": ("summary.source_counts.docs", int), "codebase_map": ("summary.source_counts.codebase_map", int),
    "used_cached_context": ("summary.used_cached_context", bool), "degraded_reasons": ("summary.degraded_reasons", list), "bypass_reason": ("summary.bypass_reason", str), "fingerprint": ("summary.fingerprint", str),
}


def fitted(v, to):
    if to is int:
        whole = isinstance(v, int) and not isinstance(v, bool) or isinstance(v, str) and re.fullmatch(r"0|-?[1-9]\d{0,17}", v)
        return int(v) if whole else None
    if to is bool:
        return v if isinstance(v, bool) else {"true": True, "false": False}.get(v) if isinstance(v, str) else None
    if to is list:
        return v if isinstance(v, list) and all(x is None or isinstance(x, str) for x in v) else None
    return v if isinstance(v, to) else None


def table(con, approved=()):
    out = []
    for r in rows(con, "select * from context_records"):
        try:
            top = json.loads(r["payload"] or "")
        except ValueError:
            top = None
        row = {k: r[k] for k in KEYS} | dict.fromkeys(TARGET) | {"_rest": None, "_rescued": None}
        if not isinstance(top, dict):
            out.append(row | {"_status": "corrupt", "_rescued": None if r["payload"] is None else json.dumps({"": r["payload"]}, ensure_ascii=False, separators=(",", ":"))})
            continue
        flat, todo = {}, [("summary", top["summary"])] if isinstance(top.get("summary"), dict) else []
        while todo:
            at, o = todo.pop()
            for k, v in o.items():
                todo.append((f"{at}.{k}", v)) if isinstance(v, dict) else flat.update({f"{at}.{k}": v})
        for c, (p, to) in TARGET.items():
            row[c] = fitted(flat.get(p), to)
        kept = {p: v for p, v in flat.items() if v is not None and not any(q == p and row[c] is not None for c, (q, _) in TARGET.items())}
        for c, p, to in approved:
            row.setdefault(c, None)
            if row[c] is None and p in kept and fitted(kept[p], to) is not None:
                row[c] = fitted(kept.pop(p), to)
        rest = {k: v for k, v in top.items() if k != "summary" or not isinstance(v, dict)}
        dump = lambda o: json.dumps(o, ensure_ascii=False, separators=(",", ":")) if o else None
        out.append(row | {"_rest": dump(rest), "_rescued": dump(dict(sorted(kept.items()))), "_status": "rescued" if kept else "ok"})
    return out


def p4_replayed(con):
    got = table(con, [("note", "summary.note", str), ("bypass_reasons", "summary.bypass_reason", list)])
    return [{"note": None, "bypass_reasons": None} | r for r in got]


NOISE = {"misc", "other", "others", "general", "generic", "unknown", "uncategorized"}


def merged_domains(con):
    by = {}
    for r in rows(con, "select repo_id, domain_id, domain_name, description, paths, keywords from domains where repo_id is not null order by domain_id"):
        name = (r["domain_name"] or "").strip()
        if not name or name.lower() in NOISE:
            continue
        new = {"name": r["domain_name"], "description": r["description"] or "", "paths": {p for p in r["paths"] or [] if p}, "keywords": {k for k in r["keywords"] or [] if k}, "members": 1}
        clusters = by.setdefault(r["repo_id"], [])
        low = lambda c: {k.strip().lower() for k in c["keywords"]} - {""}
        key = lambda c: c["name"].strip().lower()
        plural = lambda a, b: a == b + "s" or b == a + "s"
        for i, c in enumerate(clusters):
            w, p = low(c) & low(new), c["paths"] & new["paths"]
            if key(c) == key(new) or plural(key(c), key(new)) or len(w) >= 2 and 2 * len(w) >= min(len(low(c)), len(low(new))) or p and 5 * len(p) >= 3 * min(len(c["paths"]), len(new["paths"])):
                size = lambda x: (len(x["paths"]), len(x["keywords"]), len(x["description"].strip()))
                win = (new if key(new).endswith("s") and key(new) == key(c) + "s" else c) if plural(key(c), key(new)) else new if size(new) > size(c) else c
                lose = c if win is new else new
                clusters[i] = {"name": win["name"], "description": win["description"] or lose["description"], "paths": c["paths"] | new["paths"], "keywords": c["keywords"] | new["keywords"], "members": c["members"] + 1}
                break
        else:
            clusters.append(new)
    return [{"repo_id": k, "no": i, **c, "paths": sorted(c["paths"]), "keywords": sorted(c["keywords"])} for k, cs in by.items() for i, c in enumerate(cs)]


def normalised_texts(con):
    out = []
    for r in rows(con, "select doc_id, text from documents"):
        t = r["text"]
        if t is not None:
            t = unicodedata.normalize("NFKC", t).translate(str.maketrans("，。：；（）", ",.:;()"))
            t = re.sub(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", t)
            t = "".join(c.lower() if c.isascii() else c for c in t)
            for a, b in (("修正", "修复"), ("调整", "优化"), ("接入", "新增"), ("引入", "新增")):
                t = t.replace(a, b)
            t = re.sub(r"(?<![\w])[0-9]+(\.[0-9]+)?(?![\w])", "<NUM>", t).strip(" ")
        out.append({"doc_id": r["doc_id"], "digest": None if t is None else hashlib.md5(t.encode()).hexdigest(), "chars": None if t is None else len(t)})
    return out


def code_symbols(con):
    out = []
    for r in rows(con, "select doc_id, text from documents where text is not null"):
        for code in re.findall(r"(?s)```py\n(.*?)```", r["text"]):
            out.append({"doc_id": r["doc_id"], "kind": "block", "name": code.split("(")[0], "line": 1})
            try:
                body = ast.parse(code).body
            except SyntaxError:
                continue
            for n in body:
                if isinstance(n, ast.FunctionDef) and n.name[0] != "_":
                    out.append({"doc_id": r["doc_id"], "kind": "function", "name": n.name, "line": n.lineno})
                if isinstance(n, ast.ClassDef):
                    out.append({"doc_id": r["doc_id"], "kind": "class", "name": n.name, "line": n.lineno})
                    out += [{"doc_id": r["doc_id"], "kind": "method", "name": f"{n.name}.{m.name}", "line": m.lineno} for m in n.body if isinstance(m, ast.FunctionDef) and m.name[0] != "_"]
    return out


BRUTE = {
    "p2_found": brute_instants, "p4_found": p4_found, "p4_table": table, "p4_replayed": p4_replayed, "merged_domains": merged_domains, "normalised_texts": normalised_texts, "code_symbols": code_symbols,
}
