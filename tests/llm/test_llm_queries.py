"""The queries of the training-data operators: SQL where there is some, columns, and that the core doesn't need them."""

import ast
import os
import re

import pytest
from compare import connect, same

from strataforge.llm import bpe, canon, leakage, queries
from test_texts import brute_shared  # isort: skip

D = "/root/testdata/sf0.001"


def fetch(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def shared_chars(rows, con):
    commits = [(r["raw_id"], ("none", r["raw_id"]) if r["commit_id"] is None else r["commit_id"], r["diff_chunks"]) for r in fetch(con, "select * from raw_commits")]
    assert {r["raw_id"]: r["shared_chars"] for r in rows} == brute_shared(commits)


def shared_spans(rows, con):
    commits = {r["raw_id"]: r for r in fetch(con, "select * from raw_commits")}
    for r in rows:
        here, there = commits[r["raw_id"]], commits[r["ref_raw_id"]]
        a, b = here["diff_chunks"][r["chunk_no"]], there["diff_chunks"][r["ref_chunk_no"]]
        assert here["commit_id"] != there["commit_id"] and a[r["start"] : r["stop"]] == b[r["ref_start"] : r["ref_start"] + r["stop"] - r["start"]] and r["stop"] - r["start"] >= 200
    assert rows


def all_pieces(rows, con):
    """Joined without what they repeat, the pieces of an item give it again; none is larger than the limit."""
    items = {(r["raw_id"], r["item_kind"], r["item_no"]): r["t"].encode() for r in fetch(con, """
        select raw_id, 'diff_chunks' as item_kind, i - 1 as item_no, diff_chunks[i] as t from (select *, unnest(range(1, len(diff_chunks) + 1)) as i from raw_commits) where t is not null
        union all select raw_id, 'files', 0, array_to_string(files, chr(10)) from raw_commits where len(files) > 0""")}
    parts = {}
    for r in rows:
        parts.setdefault((r["raw_id"], r["item_kind"], r["item_no"]), []).append(r)
    for k, ps in parts.items():
        whole, upto = items[k], 0
        for p in sorted(ps, key=lambda p: p["piece_no"]):
            raw = p["piece"].encode()
            assert p["start_byte"] <= upto <= p["start_byte"] + 200 and len(raw) <= 4000 and whole[p["start_byte"] : p["start_byte"] + len(raw)] == raw
            upto = p["start_byte"] + len(raw)
        assert upto == len(whole)
    assert {k for k, v in items.items() if v} <= set(parts)


def mapped_terms(rows, con):
    """Every entry is scored for every row: no index, no candidates."""
    forms, meant = {}, {}
    for t in fetch(con, "select * from canonical_terms order by term_id"):
        for f in [t["canonical"], *(t["known_aliases"] or [])]:
            if f and f.strip():
                forms.setdefault(f, []).append(t)
    index = canon.Index(sorted(forms))
    index.candidates = lambda value, near, runs: range(len(index.forms))
    for r in fetch(con, "select * from alias_entries"):
        a, c = (r["alias"] or "").strip(), (r["canonical"] or "").strip()
        if a or c:
            form = index.map(tuple(canon.words(a if c.lower() in ("", "-", "?", "tbd") else c)))[0]
            terms = forms.get(form, [])
            kind = [t["term_id"] for t in terms if t["kind"] and t["kind"].strip().lower() == (r["kind"] or "").strip().lower()]
            meant[r["alias_id"]] = (kind or [t["term_id"] for t in terms] or [-1])[0]
    assert {r["alias_id"]: r["term_id"] for r in rows} == meant


def current_rows(rows, con):
    """One row per group and filled field; where time decides it is the latest dated one."""
    members = {}
    for r in fetch(con, "select * from domains where trim(domain_name) <> '' and repo_id is not null"):
        members.setdefault((r["repo_id"], re.sub("s$", "", re.sub(r"[\s_-]+", "", r["domain_name"].lower()))), []).append(r)
    filled = {"source": lambda r: (r["source"] or "").strip(), "description": lambda r: (r["description"] or "").strip(), **{f: (lambda r, f=f: any((x or "").strip() for x in r[f] or [])) for f in ("keywords", "paths")}}
    want = {(min(m["domain_id"] for m in ms), f): [m for m in ms if ok(m)] for ms in members.values() if len(ms) > 1 for f, ok in filled.items() if any(ok(m) for m in ms)}
    assert len(rows) == len(want) and {(r["group_id"], r["field_name"]) for r in rows} == set(want)
    for r in rows:
        ms = want[r["group_id"], r["field_name"]]
        dated = sorted((m for m in ms if m["seen_at"]), key=lambda m: (-m["seen_at"].timestamp(), m["domain_id"]))
        chosen = next(m for m in ms if m["domain_id"] == r["current_id"])
        assert chosen is dated[0] if r["by"] == "time" else chosen["seen_at"] is None


def token_ids(rows, con):
    import tiktoken

    enc = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in fetch(con, "select doc_id, text from documents")}
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {i: enc.encode_ordinary(t or "") for i, t in texts.items()}


def leaked(con):
    runs = {}
    for r in fetch(con, "select item_id, text from eval_items"):
        ws = leakage.words(r["text"])
        for i in range(len(ws) - 15):
            runs.setdefault(tuple(ws[i : i + 16]), set()).add(r["item_id"])
    out = set()
    for r in fetch(con, "select doc_id, text from documents"):
        ws = leakage.words(r["text"])
        for i in range(len(ws) - 15):
            out |= {(r["doc_id"], k) for k in runs.get(tuple(ws[i : i + 16]), ())}
    return out


def exact_leaks(rows, con):
    assert {(r["doc_id"], r["item_id"]) for r in rows} == leaked(con) and len(rows) == len({*map(repr, rows)})


def near_leaks(rows, con):
    """All exact ones, and otherwise documents that share most words with a passage of the item."""
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert leaked(con) <= got
    docs, items = ({r[k]: leakage.words(r["text"]) for r in fetch(con, f"select * from {t}")} for k, t in (("doc_id", "documents"), ("item_id", "eval_items")))
    for d, i in got:
        assert len(set(docs[d]) & set(items[i])) >= 8


def subjects_of(rows, con):
    known, docs = {r["subject"] for r in fetch(con, "select * from subjects")}, {r["doc_id"] for r in fetch(con, "select doc_id from documents where length(trim(text)) > 0")}
    assert len({(r["doc_id"], r["subject"]) for r in rows}) == len(rows) and {r["subject"] for r in rows} <= known and {r["doc_id"] for r in rows} <= docs


CHECKS = {
    "p3_pieces": all_pieces, "p5_found": shared_chars, "p5_spans": shared_spans, "p6_found": mapped_terms, "p7_currency": current_rows, "p8_ids": token_ids, "p9_found": exact_leaks, "p9_near": near_leaks,
    "p10_found": subjects_of,
}
COLUMNS = {
    "p1_found": ["on_field", "id_a", "id_b"], "p3_found": ["raw_id", "item_kind", "item_no", "case_kind"], "p5_found": ["raw_id", "shared_chars"], "p6_found": ["alias_id", "term_id"],
    "p7_found": ["group_id", "field_name", "from_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "subject"],
}


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, D)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in queries.SQL:
        same(df, connect(D), queries.SQL[name])
    else:
        CHECKS[name]([r.asDict() for r in df.collect()], connect(D))


def test_nothing_else_imports_it():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "strataforge")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    tree = ast.parse(open(os.path.join(folder, f), encoding="utf-8").read())
                    for n in ast.walk(tree):
                        names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
                        assert not any("llm" in x.split(".") for x in names), (f, names)
