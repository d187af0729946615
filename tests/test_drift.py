"""Schema drift against a brute-force reading of the files in memory."""

import json
import os
from collections import defaultdict

import pytest

from strataforge.operators import drift

KEYS = ["record_id"]


def flat(obj, at="summary"):
    for k, v in obj.items():
        if isinstance(v, dict):
            yield from flat(v, f"{at}.{k}")
        else:
            yield f"{at}.{k}", v


def kind(v):
    if isinstance(v, bool):
        return "b"
    if isinstance(v, list):
        inner = {("array" if isinstance(x, list) else "o" if isinstance(x, dict) else kind(x)) for x in v if x is not None}
        return ("a", frozenset(inner)) if inner else None
    return {str: "s", int: "n", float: "n", type(None): None}[type(v)]


def brute(rows):
    streams = defaultdict(lambda: defaultdict(list))
    for r in sorted(rows, key=lambda r: r["record_id"]):
        try:
            p = json.loads(r["payload"] or "")
        except ValueError:
            continue
        if isinstance(p, dict) and r["stream_id"] is not None and r["file_seq"] is not None:
            streams[r["stream_id"]][r["file_seq"]].append((r["context_key"], dict(flat(p["summary"])) if isinstance(p.get("summary"), dict) else {}))
    out = set()
    for s, files in streams.items():
        seqs = sorted(files)
        have = {q: {f for _, d in files[q] for f in d} for q in seqs}
        types = {q: {f: {kind(d[f]) for _, d in files[q] if f in d} - {None} for f in have[q]} for q in seqs}
        for i in range(1, len(seqs)):
            a, b = seqs[i - 1], seqs[i]
            gone, fresh = have[a] - have[b], have[b] - have[a]
            va, vb = {}, {}
            for v, q in ((va, a), (vb, b)):
                for k, d in files[q]:
                    if k is not None:
                        v.setdefault(k, d)
            both = va.keys() & vb.keys()
            done = set()
            for new in sorted(fresh):
                for old in sorted(gone - done):
                    pairs = [(va[k].get(old), vb[k].get(new)) for k in both]
                    pairs = [x for x in pairs if x != (None, None)]
                    if len(pairs) >= 3 and all(kind(x) == kind(y) and x == y and x is not None and y is not None for x, y in pairs):
                        out.add((s, b, "renamed", new, old))
                        done |= {old, new}
                        break
            out |= {(s, b, "added", f, "") for f in fresh - done} | {(s, b, "removed", f, "") for f in gone - done}
            for f in have[a] & have[b]:
                if types[b][f]:
                    for j in range(i - 1, -1, -1):
                        if f not in have[seqs[j]]:
                            break
                        if types[seqs[j]][f]:
                            if types[seqs[j]][f] != types[b][f]:
                                out.add((s, b, "retyped", f, ""))
                            break
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_changes_on_the_table(spark, sf):
    d = f"/root/testdata/{sf}/context_records.parquet"
    if not os.path.exists(d):
        pytest.skip("no test data")
    df = spark.read.parquet(d)
    got = {tuple(r) for r in drift.record_changes(df).collect()}
    want = brute([r.asDict() for r in df.select("record_id", "stream_id", "file_seq", "context_key", "payload").collect()])
    assert got == want and len(got) > 50


SCHEMA = "record_id long, stream_id long, file_seq int, context_key string, payload string"


def rec(i, q, k, summary, s=1):
    return (i, s, q, k, summary if summary is None or isinstance(summary, str) else json.dumps({"summary": summary}))


def test_changes_edges(spark):
    rows = []
    for k in range(3):
        rows.append(rec(10 + k, 1, f"k{k}", {"a": k, "n": None, "x": [1, None]}))
        rows.append(rec(20 + k, 3, f"k{k}", {"b": k, "n": "t" if k else None, "x": []}))
        rows.append(rec(30 + k, 4, f"k{k}", {"b": str(k), "n": 5, "x": ["s"]}))
    rows += [rec(40, 2, "k0", "{cut"), rec(41, 2, "k1", None), rec(42, 5, "k0", "[1]"), rec(43, None, "k0", {"z": 1}), rec(44, 6, "k0", {}), rec(44, 6, "k0", {})]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in drift.record_changes(df).collect()}
    assert got == {
        (1, 3, "renamed", "summary.b", "summary.a"),
        (1, 4, "retyped", "summary.b", ""), (1, 4, "retyped", "summary.n", ""), (1, 4, "retyped", "summary.x", ""),
        (1, 6, "removed", "summary.b", ""), (1, 6, "removed", "summary.n", ""), (1, 6, "removed", "summary.x", ""),
    }
    assert got == brute([dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in rows])


def test_changes_of_nothing(spark):
    assert drift.record_changes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_enforce_keeps_everything(spark):
    payloads = [
        {"summary": {"hint_count": "7", "bypass_reason": ["x"], "source_counts": {"docs": 2, "more": 1.5}, 'odd "q"\\': [{"a": None}], "degraded_reasons": []}},
        {"summary": {"hint_count": 7.5, "used_cached_context": "true", "bypass_reason": "b", "note": "é"}},
        {"other": 1},
    ]
    rows = [(i, json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)] + [(3, "{cut"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "record_id long, payload string")
    out = {r.record_id: r for r in drift.enforce(df, KEYS).collect()}
    assert out[0].hint_count == 7 and out[0].docs == 2 and out[0].degraded_reasons == [] and out[0].bypass_reason is None and out[0]._status == "rescued"
    assert json.loads(out[0]._rescued) == {"summary.bypass_reason": ["x"], "summary.source_counts.more": 1.5, 'summary.odd "q"\\': [{"a": None}]}
    assert out[1].used_cached_context is True and out[1].hint_count is None and json.loads(out[1]._rescued) == {"summary.hint_count": 7.5, "summary.note": "é"}
    assert (out[2]._status, out[2]._rescued, out[2]._rest, out[1]._rest) == ("ok", None, '{"other":1}', None)
    assert out[3]._status == "corrupt" and json.loads(out[3]._rescued) == {"": "{cut"}
    assert (out[4]._status, out[4]._rescued) == ("corrupt", None) and json.loads(out[5]._rescued) == {"": ""}
    again = {r.record_id: r for r in drift.replay(drift.enforce(df, KEYS), [("note", "summary.note", "string"), ("score", "summary.hint_count", "double"), ("reasons", "summary.bypass_reason", "array<string>")]).collect()}
    assert again[1].note == "é" and again[1].score == 7.5 and again[1]._rescued is None and again[1]._status == "ok"
    assert again[0].reasons == ["x"] and set(json.loads(again[0]._rescued)) == {"summary.source_counts.more", 'summary.odd "q"\\'}
    assert again[3]._status == "corrupt" and json.loads(again[3]._rescued) == {"": "{cut"}


def test_odd_payloads(spark):
    """A path twice, numbers of any precision, escapes: nothing ends the job, nothing is lost."""
    texts = [
        '{"summary":{"a.b":1,"a":{"b":2}}}', '{"summary":{"x":0.12345678901234567890123,"y":1.0,"z":1e999,"w":-0,"v":[1.50,{"k":2e5}]},"o":{"p":1.10}}',
        '{"summary":{"hint_count":1.0,"source_counts":{"docs":" 7 ","codebase_map":"12"},"used_cached_context":"True","degraded_reasons":[null,"a"]}}', '{"summary":{"t":"\\u0001\\\\ \\" é"}}', '{"summary":{"n":' + "9" * 5000 + "}}",
        '{"summary":[1]}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, payload string")
    out = {r.record_id: r for r in drift.enforce(df, KEYS).collect()}
    assert out[0]._rescued == '{"summary.a.b":1,"summary.a.b#1":2}'
    assert out[1]._rescued == '{"summary.v":[1.50,{"k":2e5}],"summary.w":-0,"summary.x":0.12345678901234567890123,"summary.y":1.0,"summary.z":1e999}' and out[1]._rest == '{"o":{"p":1.10}}'
    assert out[2].codebase_map == 12 and out[2].degraded_reasons == [None, "a"] and json.loads(out[2]._rescued) == {"summary.hint_count": 1.0, "summary.source_counts.docs": " 7 ", "summary.used_cached_context": "True"}
    assert json.loads(out[3]._rescued) == {"summary.t": '\x01\\ " é'} and len(out[4]._rescued) == 5000 + len('{"summary.n":}') and (out[5]._status, out[5]._rest) == ("ok", '{"summary":[1]}')
    assert drift.replay(drift.enforce(df, KEYS), [("x", "summary.x", "double")]).filter("record_id = 1").first().x == 0.12345678901234568


def test_many_files_of_one_stream(spark, monkeypatch):
    """Neighbours are found across the parts that a stream is cut into."""
    monkeypatch.setattr(drift, "FILES", 4)
    rows = [rec(100 * q + k, q * q, f"k{k}", {"a" if q % 3 else "b": k, "c": q if q % 2 else "x"}) for q in range(12) for k in range(3)]
    got = {tuple(r) for r in drift.record_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute([dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in rows]) and any(r[2] == "renamed" for r in got)
