"""Pieces, shared spans, tokens, leaks and subjects against brute force, round trips and held-out truth."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.llm import bpe, leakage, pieces, spans, subjects

LINES = st.lists(st.text(alphabet="ab é日😀\r", max_size=30), max_size=30)


@settings(max_examples=200, deadline=None)
@given(LINES, st.sampled_from(["\n", "\r\n"]), st.integers(8, 60), st.integers(0, 7))
def test_pieces_round_trip(lines, end, limit, overlap):
    raw = end.join(lines).encode()
    plan = pieces.plan(raw, limit, overlap)
    assert b"".join(raw[f:e] for _, e, f, _ in plan) == raw
    before = (0, 0)
    for n, (s, e, f, hard) in enumerate(plan):
        raw[s:e].decode()  # never inside a character
        assert e - s <= limit and s <= f and f - s <= overlap and f == before[1] and (n == 0 or s >= before[0])
        assert e > f or not raw
        before = (s, e)
    content = raw.replace(b"\r\n", b"\n").split(b"\n") if end == "\r\n" else None
    if content is not None and b"\r" not in raw.replace(b"\r\n", b""):
        assert any(h for *_, h in plan) == (len(raw) > limit and any(len(c) > limit for c in content))


def test_pieces_of_a_table(spark):
    long = "x" * 4001
    rows = [(1, ["a\n" * 3000, None, "", "s"], ["f" * 2000, None, "g" * 1999]), (2, [long], ["f" * 4001]), (3, None, None), (4, [], []), (5, ["é" * 2000, "é" * 2000 + "\n" * 9, ("y" * 4000 + "\r\n") * 3], ["a"] * 2)]
    df = spark.createDataFrame(rows, "raw_id long, diff_chunks array<string>, files array<string>").withColumn("text", F.lit("clash")).withColumn("pieces", F.lit(1))
    got = {tuple(r) for r in pieces.found(df).collect()}
    assert got == {
        (1, "diff_chunks", 0, "oversized"), (2, "diff_chunks", 0, "oversized"), (2, "diff_chunks", 0, "long_line"), (2, "files", 0, "oversized"),
        (5, "diff_chunks", 1, "oversized"), (5, "diff_chunks", 2, "oversized"),
    }
    out = pieces.pieces(pieces.items(df), ["raw_id", "item_kind", "item_no"]).collect()
    back = {}
    for r in sorted(out, key=lambda r: (r.raw_id, r.item_kind, r.item_no, r.piece_no)):
        assert len(r.piece.encode()) <= 4000 and r.overlap_bytes <= 200
        k = (r.raw_id, r.item_kind, r.item_no)
        back[k] = back.get(k, b"") + r.piece.encode()[r.overlap_bytes :]
    for i, chunks, files in rows:
        for n, c in enumerate(chunks or []):
            if c is not None:
                assert back[i, "diff_chunks", n].decode() == c
    assert back[1, "files", 0].decode() == "f" * 2000 + "\n" + "g" * 1999
    assert pieces.found(df.limit(0)).count() == 0


def brute_shared(rows):
    where = {}
    for _, o, ts in rows:
        for t in ts or []:
            for s in range(len(t or "") - spans.MIN + 1):
                where.setdefault(t[s : s + spans.MIN], set()).add(o)
    out = {}
    for i, o, ts in rows:
        n = 0
        for t in ts or []:
            hit = np.zeros(len(t or ""), bool)
            for s in range(len(t or "") - spans.MIN + 1):
                if where[t[s : s + spans.MIN]] - {o}:
                    hit[s : s + spans.MIN] = True
            n += int(hit.sum())
        if n:
            out[i] = n
    return out


@pytest.mark.parametrize("setting", [{}, {"MOST": 1}, {"PER_TASK": 5}])
def test_shared_spans(spark, setting, monkeypatch):
    for k, v in setting.items():
        monkeypatch.setattr(spans, k, v)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh é日😀\n") for _ in range(n))
    common, edge, near = word(500), word(200), word(199)
    rows = [(i, f"c{i}", [word(rng.randint(0, 300)) + common + word(90), None, ""]) for i in range(8)]  # a third has one passage
    rows += [(10, "d", [word(50) + edge, near]), (11, "e", [edge, word(30) + near + "!"]), (12, "d", [edge]), (13, None, [common]), (14, None, [common[:250]]), (15, "f", None), (16, "g", [])]
    rows += [(17, "h", ["-" * 900]), (18, "i", ["-" * 260 + word(20)]), (19, "j", [common[100:350], common[120:320] + word(10)]), (20, "k", [word(5000)]), (21, "k", [rng.choice("xy") * 3000])]
    df = spark.createDataFrame(rows, "raw_id long, commit_id string, diff_chunks array<string>").withColumn("h", F.lit(1))
    got = {r.row_id: r.shared_chars for r in spans.shared_chars(spans.commit_texts(df)).collect()}
    assert got == brute_shared(rows)
    texts = {i: (o, ts) for i, o, ts in rows}
    found = spans.shared_spans(spans.commit_texts(df)).collect()
    for r in found:  # each factor stands at its reference, in a row of another commit
        here, there = texts[r.row_id][1][r.no], texts[r.ref_row][1][r.ref_no]
        assert r.stop - r.start >= spans.MIN and here[r.start : r.stop] == there[r.ref_start : r.ref_start + r.stop - r.start]
        assert texts[r.row_id][0] is None or texts[r.row_id][0] != texts[r.ref_row][0]
    assert found


def test_parse_at_borders():
    """The first factor is the longest, references that go on beyond its border are tried; runs of scanned parts meet."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, seed, z = word(60), word(64), word(60)
    blocks = [a + seed + z, word(10) + a[20:] + seed + z[:30] + word(9), word(5) + a[40:] + seed + z + word(9), a[50:] + seed + z[:10]]
    place = np.array([60, 50, 25, 10])
    owner = np.array([1, 2, 3, 4])
    got = {(x, y, m) for k, x, y, m in spans.parse(blocks, place, owner, owner, 100) if k == 0}
    assert {(x, y) for x, y, _ in got} == {(20, 154), (40, 184)} and {m for *_, m in got} == {1, 2}
    assert spans.parse(blocks[:1], place[:1], owner[:1], owner[:1], 100) == []


def test_scan_is_linear_and_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    text = rng.choice(np.frombuffer(b"abcdefghij", np.uint8), 40_000).tobytes().decode()
    batch = lambda ts: pa.RecordBatch.from_arrays([pa.array([1]), pa.array([5]), pa.array([ts], pa.list_(pa.string()))], ["row_id", "owner", "texts"])
    starts = lambda: sorted(int(f) + i for *_, first, count, _, _, _ in spans._scan(iter([batch([text])])) for f, n in zip(first, count) for i in range(n))
    whole = starts()
    monkeypatch.setattr(spans, "_BLOCK", 700)
    assert starts() == whole == list(range(len(text) - spans.MIN + 1))
    blocks = [len(h) for _, _, _, h, *_ in spans._scan(iter([batch(["-" * 30_000])]))]
    assert sum(blocks) <= 30  # repetitive text is few blocks, not one per window


def test_shared_spans_of_nothing(spark):
    df = spark.createDataFrame([], "raw_id long, commit_id string, diff_chunks array<string>")
    assert spans.shared_chars(spans.commit_texts(df)).count() == 0


RANKS = os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    if not os.path.exists(RANKS):
        pytest.skip("no vocabulary")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks(RANKS))


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_tokens_of_any_text(reference, encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder.encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["<|endoftext|> 's\n\n  x", "a" * 4000, " " * 3000, "=-" * 1500, "日本語" * 500, "ａｂ​﻿", "abracadabra" * 300])
def test_tokens_of_odd_texts(reference, encoder, text):
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text) and reference.decode(ids) == text


def test_tokens_of_a_table(spark, reference):
    rows = [(1, "Hello <|endoftext|>"), (2, ""), (3, None), (4, "é" * 300_000), (1, "Hello <|endoftext|>"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode_column(df, "doc_id", "text").collect()), key=lambda x: (x[0] or 0, len(x[1])))
    assert got == sorted(((i, reference.encode_ordinary(t) if t else []) for i, t in rows), key=lambda x: (x[0] or 0, len(x[1])))
    assert dict(bpe.encode_column(df.limit(0), "doc_id", "text").dtypes)["ids"] == "array<int>"


def test_leaks(spark):
    words = [f"w{i}" for i in range(60)]
    item = " ".join(words[:40])
    bare = " ".join(words[10:26])
    hide = bare.replace("w12", "W​12").replace("w15", "ｗ15").replace(" w20", "_w20­")
    docs = [(1, "x " + bare + " y"), (2, " ".join(words[10:25])), (3, hide.upper()), (4, bare.replace("w13", "w13 extra")), (5, None), (6, ""), (7, "z " * 50_000 + bare), (8, ", ".join(words[24:40]) + "!"), (1, "x " + bare)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, item), (2, item), (3, " ".join(words[:15])), (4, None), (None, item), (5, "")], "item_id long, text string")
    got = {tuple(r) for r in leakage.leaks(df, items, "doc_id", "item_id").collect()}
    assert got == {(d, i) for d in (1, 3, 7, 8) for i in (1, 2)}
    assert leakage.leaks(df.limit(0), items, "doc_id", "item_id").count() == 0 and leakage.leaks(df, items.limit(0), "doc_id", "item_id").count() == 0
    near = {tuple(r) for r in leakage.leaks(df, items, "doc_id", "item_id", edits=2, samples=6, repeats=20).collect()}
    assert near >= got and (4, 1) in near


def test_recall_of_near_leaks():
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(20)]
    docs = []
    for _ in range(200):
        w = rng.choice(items)[1].split()[5:21]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + ["q"] + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + ["q"] + w[k:]])
        docs.append(" ".join(["a", "b", *w, "c", "d"]))

    def edits(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    want = set()
    for d, t in enumerate(docs):
        w = t.split()
        for i, u in items:
            v = u.split()
            if any(len(set(w[k : k + 16]) & set(v[m : m + 16])) > 8 and edits(w[k : k + 16], v[m : m + 16]) <= 2 for k in range(len(w) - 15) for m in range(15)):
                want.add((d, i))
    a, b = leakage.Items(items, edits=2, samples=6, repeats=16).match(docs)
    got = set(zip(a.tolist(), b.tolist()))
    assert got <= want and len(got) >= 0.9 * len(want) > 50


def edited_passages(rng, n, vocab, items):
    """Documents with 16 words of an item in which up to three words are changed, dropped or added, never at the ends, between words of no item."""
    docs = []
    for _ in range(n):
        v = rng.choice(items)[1].split()
        k = rng.randrange(len(v) - 15)
        w = v[k : k + 16]
        for _ in range(rng.choice([0, 1, 2, 2, 2, 3])):
            k = rng.randrange(1, len(w) - 1)
            w = rng.choice([w[:k] + [f"q{rng.random()}"] + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + [f"q{rng.random()}"] + w[k:], w[:k] + [rng.choice(vocab)] + w[k:]])
        docs.append(" ".join([*(f"a{rng.random()}" for _ in range(rng.randint(0, 3))), *w, *(f"b{rng.random()}" for _ in range(rng.randint(0, 3)))]).replace(".", ""))
    return docs


def free_ends(w, v):
    """Smallest edit distance of v from any part of w."""
    last = [0] * (len(w) + 1)
    for i, x in enumerate(v, 1):
        row = [i]
        for j, y in enumerate(w, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return min(last)


def test_recall_of_edited_passages():
    """Words added or dropped inside a passage of 16 words don't cost its end too; the truth knows no windows in the document."""
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(20)]
    docs = edited_passages(rng, 400, vocab, items)
    want = {(d, i) for d, t in enumerate(docs) for i, u in items if any(free_ends(t.split(), u.split()[m : m + 16]) <= 2 for m in range(15))}
    a, b = leakage.Items(items, edits=2, samples=6, repeats=16, slack=2).match(docs)
    got = set(zip(a.tolist(), b.tolist()))
    a, b = leakage.Items(items, edits=2, samples=6, repeats=16).match(docs)
    assert got <= want and len(got) >= 0.9 * len(want) > 250 and len(set(zip(a.tolist(), b.tolist()))) < 0.9 * len(want), (len(got & want), len(got), len(want), len(a))


def test_two_words_added_or_dropped_at_any_place(spark):
    w = [f"w{i}" for i in range(16)]
    docs = [(1, [*w[:5], "x", *w[5:9], "y", *w[9:]]), (2, [*w[:5], *w[6:9], *w[10:]]), (3, [*w[:5], "x", *w[5:9], "y", *w[9:12], "z", *w[12:]]), (4, [*w[:5], *w[6:9], *w[10:12], *w[13:]])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    assert {r.doc_id for r in leakage.leaks(df, items, "doc_id", "item_id", edits=2, samples=2, repeats=60, slack=2).collect()} == {1, 2}


def sample_docs(n, rng):
    """Invented remarks on two areas and on none, with passing remarks, in one wording each."""
    terms = {"law": [f"court{c} fee{c}" for c in "abcdefgh"], "sport": [f"goal{c} log{c}" for c in "abcdefgh"]}
    plain = ["the {} retries {} times", "drop the {} flag", "{} was split into {}", "tests for {} cover {} cases"]
    nouns = [f"mod{i}" for i in range(40)]
    out = []
    for _ in range(n):
        areas = rng.choice([[], ["law"], ["sport"], ["law", "sport"]])
        lines = [rng.choice(plain).format(rng.choice(nouns), rng.choice(nouns)) for _ in range(rng.randint(2, 6))]
        for a in areas:
            for _ in range(rng.randint(2, 4)):
                x, y = rng.sample(terms[a], 2)
                lines.append(f"each {x} keeps its {y} next to {rng.choice(nouns)}")
        other = [a for a in terms if a not in areas]
        if other and rng.random() < 0.5:
            lines.append(f"unlike the {rng.choice(terms[rng.choice(other)])} in the old demo this stays off")
        rng.shuffle(lines)
        out.append(("\n".join(lines), set(areas)))
    return out


@pytest.mark.parametrize("n", [60, 250])
def test_subjects_from_few_noisy_labels(spark, n):
    """Held-out accuracy; calibrated the same way with few labels and with more."""
    rng = random.Random(4)
    train, test = sample_docs(500, rng), sample_docs(300, rng)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(train + test)], "doc_id long, text string")
    noisy = [(i, s if rng.random() > 0.05 else {rng.choice(["law", "sport"])}) for i, (_, s) in enumerate(train[:n])]
    labels = spark.createDataFrame([(i, a) for i, s in noisy for a in s or {"none"}], "doc_id long, subject string")
    model = subjects.train(docs, labels, spark.createDataFrame([("law",), ("sport",)], "subject string"))
    assert model.report["labelled"] == n and (model.threshold < 1).all()
    hit = model.documents([t for t, _ in test], subjects.Grams()) >= model.threshold
    got = [{a for a, h in zip(model.areas, row) if h} for row in hit]
    right = sum(len(g & s) for g, (_, s) in zip(got, test))
    precision, recall = right / max(1, sum(map(len, got))), right / sum(len(s) for _, s in test)
    assert precision > 0.85 and recall > 0.9, (precision, recall)


def test_summed_counts_are_those_of_one_pass(spark):
    """Counts over all documents don't depend on how these are cut up; long texts count as a whole."""
    rng = random.Random(5)
    texts = [t for t, _ in sample_docs(80, rng)] + ["\n".join(t for t, _ in sample_docs(300, rng)), None, ""]
    grams = subjects.Grams()

    def add(sums, batch):
        for at, n in subjects._pieces(batch):
            sums[:, 0] += np.bincount(subjects.Grams().read(batch.column(0).slice(at, n).to_pylist())[2], minlength=len(sums)).astype(np.float32)

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = np.bincount(grams.read(texts)[2], minlength=1 << subjects.BITS)
    for parts in (1, 5):
        assert (subjects._summed(df.repartition(parts), ["text"], 1 << subjects.BITS, 1, add)[:, 0] == want).all()


def test_subjects_of_a_table(spark):
    rng = random.Random(4)
    docs = [(i, t) for i, (t, _) in enumerate(sample_docs(60, rng))] + [(100, None), (101, ""), (102, "word " * 60_000), (103, " ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject", F.lit("clash"))
    areas = spark.createDataFrame([("law",), ("sport",), (None,)], "subject string")
    labels = spark.createDataFrame([(i, "law" if "court" in (t or "") else "none") for i, t in docs[:40]] + [(None, "law"), (5, None), (6, "other")], "doc_id long, subject string")
    out = subjects.classify(df, subjects.train(df, labels, areas))
    assert out.columns == ["doc_id", "subject"] and {r.subject for r in out.collect()} <= {"law", "sport"}
    assert subjects.classify(df, subjects.train(df, labels.limit(0), areas)).count() == 0
    assert subjects.classify(df.limit(0), subjects.train(df.limit(0), labels, areas)).count() == 0


def test_banded_distance():
    """Equal to the whole table up to the number of edits, with and without a free end."""
    rng = np.random.default_rng(4)
    for slack, most in ((0, 2), (2, 2), (0, 1), (1, 3)):
        a = rng.integers(0, 5, (300, 8))
        b = np.hstack([a, np.full((300, slack), -1)])
        for i in range(300):
            for _ in range(rng.integers(0, 4)):
                b[i] = np.insert(np.delete(b[i], rng.integers(0, len(b[i]))), rng.integers(0, len(b[i])), rng.integers(0, 5))
        got = leakage._distance(a.astype(np.int32), b.astype(np.int32), most, slack)
        for x, y, d in zip(a, b, got):
            t = np.add.outer(np.arange(9), np.arange(len(y) + 1))
            for i in range(1, 9):
                for j in range(1, len(y) + 1):
                    t[i, j] = min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
            want = t[8, len(y) - 2 * slack :].min()
            assert d == want if want <= most else d > most


def test_items_in_blocks(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(words[20 * i : 20 * i + 20])) for i in range(20)]
    docs = spark.createDataFrame([(k, " ".join(["x", *words[20 * k + 2 : 20 * k + 19], "y"])) for k in range(20)] + [(90, None), (91, "")], "doc_id long, text string")
    listed = spark.createDataFrame(items + [(None, items[0][1]), (77, None)], "item_id long, text string")
    monkeypatch.setattr(leakage, "ITEM_CHARS", 300)
    assert {tuple(r) for r in leakage.leaks(docs, listed, "doc_id", "item_id").collect()} == {(k, k) for k in range(20)}


def test_leanings_in_bounded_memory(monkeypatch):
    """However many n-grams there are, little memory is taken besides theirs; cut anywhere, the same comes out."""
    import tracemalloc

    rng = np.random.default_rng(1)
    rem = np.repeat(np.arange(20_000, dtype=np.int32), 60)
    feat = rng.integers(0, 1 << subjects.BITS, len(rem)).astype(np.int32)
    sums = np.zeros(((1 << subjects.BITS) + 1, 17), np.float32)
    sums[:-1, 1:9] = rng.integers(0, 50, (1 << subjects.BITS, 8))
    sums[:, 0] = sums[:, 1:9].sum(axis=1) + 3
    sums[-1] = 50_000
    step, own = subjects.Step.of(sums, 8), np.zeros((20_000, 8), np.float32)
    tracemalloc.start()
    want = step.lean(rem, feat, own, own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6, peak  # the leanings of all n-grams at once are 38 MB, several times over
    texts = ["One remark. Another one\n三个字。" * 5, None, "", "A long line without an end " * 40, "x. y"]
    read = subjects.Grams().read(texts)
    monkeypatch.setattr(subjects, "LEAN_CELLS", 800)
    monkeypatch.setattr(subjects, "READ_CHARS", 30)
    assert np.array_equal(step.lean(rem, feat, own, own), want) and len(np.unique(want)) > 100
    assert all(np.array_equal(a, b) for a, b in zip(subjects.Grams().read(texts), read))
