"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams, read remark by remark.

A text is cut into remarks (lines and sentences); of each remark the n-grams of 1 to 4 words, hashed, are its features.
Labels are few, noisy and by document, so weak labels by remark are made first: a remark bears an area of its document
if one of its n-grams leans to that area. The leaning is counted from the labelled documents, then again over *all*
documents in ROUNDS passes: from the remarks that the leanings so far mark, where documents without a label join with the
areas that their surest remarks bear (an n-gram beside a known one is learned that way). A remark in several copies counts
once altogether, and never for itself. One logistic classifier per area is then fitted to the marked remarks of a sample.

What only passes an area by is learned without labels too: the wording of remarks whose area no other remark of the
document supports. A document is about the areas that some remark bears above the calibrated threshold, passing ones
not counted. Thresholds come from a cross-validation over the labelled sample, the same at any number of labels.

The counts are arrays of fixed size (BITS, COPY_BITS) that tasks sum up; the sample (LABELLED, WEAK, SAMPLE_CHARS) is what
the fits, one task each, are given; every document is classified.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bounds of the sample that the classifiers are fitted to: documents with a label, documents with weak labels, characters of
#: each of the two parts. They bound nothing else: counts are of all documents, and all are classified.
LABELLED, WEAK, SAMPLE_CHARS = 6_000, 6_000, 20_000_000
BITS, NGRAM = 19, 4
#: Buckets in which the copies of a remark are counted, rounds of leanings, parts of the cross-validation, and labelled documents
#: of an area whose own threshold weighs as much as the shared one.
COPY_BITS, ROUNDS, FOLDS, PULL = 22, 3, 5, 40.0
_SLICES = 64
#: Characters that are read, leanings (n-grams x areas) and n-grams that are counted at a time: they bound memory, not results.
READ_CHARS, LEAN_CELLS, COUNTED = 1 << 20, 1 << 20, 1 << 22
#: Strength of the prior of an n-gram's leaning, share of right labels (some are wrong) at which a leaning is sure, and
#: bounds of such leanings: LEAST always, MOST once the counts rest on marked remarks.
PRIOR, PRECISE, LEAST, MOST = 3.0, 0.85, 1.2, 5.0
#: Times the classifiers are fitted anew to what they found, and rounds of each fit.
REFITS, FIT_ROUNDS = 1, 30
_U = np.uint64
_REMARK = re.compile(r"[\r\n]+|(?<=[.!?])\s+|(?<=[。！？])")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿가-힣]|[^\W\d_぀-ヿ㐀-鿿가-힣]+|\d+")
_CAMEL = re.compile(r"(?<=[^\W\dA-Z_])(?=[A-Z])")


class Grams:
    """Texts as (remark no, feature) pairs; words are hashed once."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def _hash(self, w: str) -> int:
        import xxhash

        if len(w) > 3 and w.endswith("s"):
            w = w[:-1]
        if w.isdigit():
            w = "0"
        h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[w] = h
        return h

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document of each remark, remark of each feature, feature), read READ_CHARS or one text at a time."""
        docs, rems, feats, n, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0, 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= READ_CHARS):
                chars += len(texts[end] or "")
                end += 1
            doc, rem, feat = self._read(texts[at:end])
            docs.append(doc + at)
            rems.append(rem + np.int32(n))
            feats.append(feat)
            n, at = n + len(doc), end
        return np.concatenate(docs), np.concatenate(rems), np.concatenate(feats)

    def _read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        memo, make = self.memo, self._hash
        doc, size, words = [], [], []
        for d, t in enumerate(texts):
            for remark in _REMARK.split(t) if t else ():
                ws = _TOKEN.findall(_CAMEL.sub(" ", remark).lower())
                if ws:
                    doc.append(d)
                    size.append(len(ws))
                    words += ws
        h = np.fromiter((memo[w] if w in memo else make(w) for w in words), np.uint64, len(words))
        rem = np.repeat(np.arange(len(size), dtype=np.int32), size)
        rs, gs, g = [], [], np.zeros(len(h), np.uint64)
        for n in range(1, NGRAM + 1):
            if len(h) < n:
                break
            g = g[: len(h) - n + 1] * _U(0x9E3779B97F4A7C15) + h[n - 1 :]
            g ^= g >> _U(29)
            ok = rem[: len(rem) - n + 1] == rem[n - 1 :]
            rs.append(rem[: len(ok)][ok])
            gs.append(((g[ok] * _U(0xBF58476D1CE4E5B9)) >> _U(64 - BITS)).astype(np.int32))
        if not rs:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        r, f = np.concatenate(rs), np.concatenate(gs)
        order = np.argsort(r, kind="stable")
        return np.array(doc), r[order], f[order]


def _signs(n: int, rem: np.ndarray, feat: np.ndarray) -> np.ndarray:
    """A hash of each remark's wording."""
    sign = np.zeros(n, np.uint64)
    if len(rem):
        head = np.flatnonzero(np.r_[True, rem[1:] != rem[:-1]])
        sign[rem[head]] = np.add.reduceat((feat.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15) ^ (feat.astype(np.uint64) << _U(40)), head)
    return sign * _U(0xBF58476D1CE4E5B9)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    areas: list[str]
    weights: np.ndarray  # features x areas
    bias: np.ndarray
    passing: np.ndarray  # per feature
    passing_bias: float
    threshold: np.ndarray
    report: dict = field(default_factory=dict)

    def remarks(self, n: int, rem: np.ndarray, feat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.stack([np.bincount(rem, self.weights[feat, a], n) + self.bias[a] for a in range(len(self.areas))], 1)
        p = np.where(z >= z.max(axis=1, keepdims=True, initial=-30.0), _sigmoid(z), 0.0)  # a remark bears one area
        return p, np.bincount(rem, self.passing[feat], n) + self.passing_bias > 0

    def documents(self, texts: list[str | None], grams: Grams) -> np.ndarray:
        """Score of each text and area: that of its best remark that isn't a passing one."""
        doc, rem, feat = grams.read(texts)
        out = np.zeros((len(texts), len(self.areas)))
        if len(doc):
            p, passing = self.remarks(len(doc), rem, feat)
            np.maximum.at(out, doc, np.where(passing[:, None], 0.0, p))
        return out


@dataclass
class Step:
    """Leanings as counted in one round: how often each n-gram stands in examples of an area, and in remarks judged not to be.

    Only n-grams that stand in an example of some area have a row (``row``: feature -> row, 0 for all others).
    """

    row: np.ndarray
    yes: np.ndarray
    no: np.ndarray
    rate: np.ndarray
    sure: float = 9.0

    @classmethod
    def of(cls, sums: np.ndarray, k: int) -> Step:
        """From sums of (judged, examples by area, in documents of the area) per feature; the last row is of the remarks themselves."""
        judged, yes, held = sums[:, 0], sums[:, 1 : k + 1], sums[:, k + 1 :]
        used = np.flatnonzero((yes[:-1] > 0).any(axis=1))
        row = np.zeros(len(sums) - 1, np.int32)
        row[used] = np.arange(1, len(used) + 1)
        no = judged[:, None] - held
        pad = np.zeros((1, k), np.float32)
        rate = (yes[-1] + 1.0) / (yes[-1] + no[-1] + 2.0)
        return cls(row, np.vstack([pad, yes[used]]).astype(np.float32), np.vstack([pad, no[used]]).astype(np.float32), rate.astype(np.float32))

    def lean(self, rem, feat, own_yes: np.ndarray, own_no: np.ndarray) -> np.ndarray:
        """Leaning of each remark to each area: that of the n-gram that leans most, in log odds over the usual ones.

        PRIOR examples at the usual rate are added, so that a rare n-gram leans little; what the remark was counted as itself
        (own_yes, own_no: remarks x areas) is left out.
        """
        n, k = own_yes.shape
        best = np.full((n, k), -np.inf, np.float32)
        held, known = np.zeros(n, bool), np.zeros(n, bool)
        some = max(1, LEAN_CELLS // max(1, k))
        for i in range(0, len(rem), some):
            r, at = rem[i : i + some], self.row[feat[i : i + some]]
            held[r] = True
            r, at = r[at > 0], at[at > 0]
            if len(r):
                known[r] = True
                p, q = np.maximum(self.yes[at] - own_yes[r], 0), np.maximum(self.no[at] - own_no[r], 0)
                w = np.log(p + PRIOR * self.rate) - np.log(q + PRIOR * (1 - self.rate)) - np.log(self.rate / (1 - self.rate))
                head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                best[r[head]] = np.maximum(best[r[head]], np.maximum.reduceat(w, head))
        best[~known] = -9.0
        best[held & ~known] = 0.0  # n-grams that nothing is known of lean nowhere
        return best


class Judged:
    """What the steps so far make of documents: which areas each holds, which remarks bear them, and whether it is judged."""

    def __init__(self, n_docs: int, doc, rem, feat, gold: np.ndarray, known: np.ndarray, weights: tuple[np.ndarray, np.ndarray]):
        self.n, self.doc, self.rem, self.feat, self.gold, self.known = n_docs, doc, rem, feat, gold, known
        self.weights, self.steps = weights, 0  # of each remark: among the labelled documents, which the first step counts, and among all
        self.holds, self.judged, self.bears = gold & known[:, None], known, gold[doc] & known[doc][:, None]
        self.top = np.full(gold.shape, -9.0, np.float32)

    @property
    def weight(self) -> np.ndarray:
        """Of each remark in the next counts: its copies count once altogether."""
        return self.weights[self.steps > 0]

    def look(self, step: Step) -> None:
        """The best leanings, without what the remark itself was counted as."""
        own_no = self.judged[self.doc][:, None] & ~self.holds[self.doc]
        w = self.weight[:, None]
        best = step.lean(self.rem, self.feat, self.bears * w, own_no * w)
        self.best = np.where(best >= best.max(axis=1, keepdims=True, initial=-9.0), best, -9.0)  # a remark leans to one area
        self.top = np.full(self.gold.shape, -9.0, np.float32)
        np.maximum.at(self.top, self.doc, self.best)

    def decide(self, sure: float) -> None:
        """A labelled area that no remark shows is left out, one that is clear without a label comes in."""
        top, known = self.top, self.known[:, None]
        self.holds = np.where(known, (self.gold & (top > LEAST)) | (top > sure + 1.0), top > sure)
        self.bears = (self.best >= np.minimum(np.maximum(sure, 0.5 * top), top)[self.doc]) & (self.best > LEAST) & self.holds[self.doc]
        self.judged = self.known | self.holds.any(axis=1) | (top.max(axis=1, initial=-9.0) < LEAST)
        self.steps += 1

    def follow(self, steps: list[Step]) -> Judged:
        for s in steps:
            self.look(s)
            self.decide(s.sure)
        return self

    def add(self, sums: np.ndarray) -> None:
        """Add this to the sums of ``Step.of``."""
        k, width = self.gold.shape[1], len(sums) - 1
        c = np.where(self.judged[self.doc], self.weight, 0.0)
        masks = [(1 + a, self.bears[:, a]) for a in range(k)] + [(1 + k + a, self.holds[self.doc, a]) for a in range(k)]
        masks = [(col, mask) for col, mask in masks if mask.any()]
        for i in range(0, len(self.rem), COUNTED):
            rem, feat = self.rem[i : i + COUNTED], self.feat[i : i + COUNTED]
            each = c[rem]
            sums[:width, 0] += np.bincount(feat, each, width)
            for col, mask in masks:
                m = mask[rem]
                np.add.at(sums[:, col], feat[m], each[m])
        sums[width, 0] += c.sum()
        for col, mask in masks:
            sums[width, col] += c[mask].sum()


def _sure(top: np.ndarray, gold: np.ndarray) -> float:
    """The leaning above which at least PRECISE of the labelled documents have the label of their first area.

    Only the first area counts: what a document mentions in passing leans as clearly and has no label.
    """
    if not len(top):
        return 9.0
    first = top.argmax(axis=1)
    rows = np.arange(len(top))
    order = np.argsort(-top[rows, first])
    x, hit = top[rows, first][order], np.cumsum(gold[rows, first][order])
    ok = np.flatnonzero((hit / np.arange(1, len(x) + 1) >= PRECISE) & (np.arange(len(x)) >= 4))
    return float(max(LEAST, x[ok[-1]])) if len(ok) else 9.0


def _logistic(rem, feat, y: np.ndarray, use: np.ndarray, width: int, l2: float = 2e-6, rate: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """One classifier per column of y, all at once, by full-batch Adagrad; y and use are remarks x classes."""
    k = y.shape[1]
    out, b = np.zeros((width, k), np.float32), np.full(k, -2.0, np.float32)
    keep = use.any(axis=1)[rem]
    if not keep.any():
        return out, b
    ids, r = np.unique(rem[keep], return_inverse=True)
    fs, f = np.unique(feat[keep], return_inverse=True)
    yy, on = y[ids].T.astype(np.float32), use[ids].T.astype(np.float32)
    m = np.maximum(1.0, on.sum(axis=1, keepdims=True))
    pos = (yy * on).sum(axis=1, keepdims=True)
    weight = np.where(yy > 0, np.minimum(4.0, (m - pos) / np.maximum(1.0, pos) / 4 + 1), 1.0).astype(np.float32) * on / m.astype(np.float32)
    del keep
    by_remark = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    order = np.argsort(f, kind="stable")
    r_of_f = r[order]
    del r, order
    by_feature = np.r_[0, np.cumsum(np.bincount(f))[:-1]]  # f is 0, 1, ..., each at least once
    w, gw, gb = np.zeros((k, len(fs)), np.float32), np.full((k, len(fs)), 1e-12, np.float32), np.full(k, 1e-12, np.float32)
    for _ in range(FIT_ROUNDS):
        for c in range(k):  # a class at a time: its weights and errors stay in the cache
            err = (_sigmoid(np.add.reduceat(w[c].take(f), by_remark) + b[c]) - yy[c]) * weight[c]
            g = np.add.reduceat(err.take(r_of_f), by_feature) + np.float32(l2) * w[c]
            gw[c] += g * g
            w[c] -= np.float32(rate) * g / np.sqrt(gw[c])
            e = err.sum()
            gb[c] += e * e
            b[c] -= np.float32(rate) * e / np.sqrt(gb[c])
    out[fs] = w.T
    return out, b


def _places(sign: np.ndarray) -> np.ndarray:
    return (sign >> _U(64 - COPY_BITS)).astype(np.int64)


class Copies:
    """How often each wording occurs, by bucket, among the labelled documents and among all."""

    def __init__(self, labelled: np.ndarray, every: np.ndarray):
        self.counts = labelled, every

    def __getstate__(self) -> tuple:
        return tuple(_packed(x) for x in self.counts)

    def __setstate__(self, state: tuple) -> None:
        self.counts = tuple(_unpacked(x) for x in state)

    def weights(self, n: int, rem: np.ndarray, feat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _places(_signs(n, rem, feat))
        return tuple((1 / np.maximum(1.0, c[at])).astype(np.float32) for c in self.counts)


def fit(texts: list[str], gold: np.ndarray, known: np.ndarray, areas: list[str], steps: list[Step], copies: Copies) -> Model:
    """Classifiers of the sampled documents; gold: documents x areas, known: which have a label. Thresholds are out of reach yet."""
    k, width, grams = len(areas), 1 << BITS, Grams()
    zero = Model(areas, np.zeros((width, k), np.float32), np.full(k, -9.0), np.zeros(width, np.float32), -9.0, np.full(k, 2.0))
    doc, rem, feat = grams.read(texts)
    del grams
    if not known.any() or not len(doc) or not k:
        return zero
    n = len(doc)
    j = Judged(len(texts), doc, rem, feat, gold, known, copies.weights(n, rem, feat)).follow(steps)
    # copies of a text repeat their remarks: each wording is one example, of a labelled document first
    once = np.zeros((n, 1), bool)
    once[np.unique(_signs(n, rem, feat), return_index=True)[1]] = True
    bears, counts = j.bears, once & np.where(j.holds[doc], j.bears, j.judged[doc][:, None])
    model = zero
    for fits in range(REFITS + 1):
        model.weights, model.bias = _logistic(rem, feat, bears, counts, width)
        if fits < REFITS:
            # an area is borne out by a second remark or by a label; a remark that stands alone is no example, for or against
            p, _ = model.remarks(n, rem, feat)
            own = p >= 0.9
            per_doc = np.zeros((len(texts), k), int)
            np.add.at(per_doc, doc, own)
            held_up = (per_doc >= 2) | (known[:, None] & gold)
            bears = own & held_up[doc]
            counts = once & ((own & held_up[doc]) | (p < 0.5))
    # passing remarks: theirs is the only one of its area in a document with others
    p, _ = model.remarks(n, rem, feat)
    own = p >= 0.5
    per_doc = np.zeros((len(texts), k), int)
    np.add.at(per_doc, doc, own)
    one = own.sum(axis=1) == 1
    area = own.argmax(axis=1)
    rest = per_doc.sum(axis=1)[doc] - per_doc[doc, area]
    alone = one & (per_doc[doc, area] == 1) & (rest >= 2)
    backed = one & (per_doc[doc, area] >= 2)
    if alone.any():
        passing, bias = _logistic(rem, feat, alone[:, None], (alone | backed)[:, None], width)
        model.passing, model.passing_bias = passing[:, 0], float(bias[0]) - float(np.log1p(5.0 / alone.sum()))  # few examples, much doubt
    return model


def thresholds(scores: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, float]:
    """Per area the threshold of the best F1 of scores that the classifiers gave to documents they weren't fitted to, and the
    overall F1. Each is drawn towards the one for all areas together, the more the fewer documents of the area there are."""
    grid = _sigmoid(np.linspace(-1.5, 8.0, 39))

    def best(x, y):
        f1 = np.array([2 * ((x >= g) & y).sum() / max(1, (x >= g).sum() + y.sum()) for g in grid])
        return float(np.median(grid[f1 >= f1.max() - 1e-9]))  # of equally good ones the middle

    shared = best(scores, truth)
    n = truth.sum(axis=0)
    own = np.array([best(scores[:, [a]], truth[:, [a]]) if n[a] else shared for a in range(scores.shape[1])])
    at = (n * own + PULL * shared) / (n + PULL)
    hit = scores >= at
    return at, float(2 * (hit & truth).sum() / max(1, hit.sum() + truth.sum()))


# ---- over all documents


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, np.float32).tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.float32)


def _summed(docs: DataFrame, columns: list[str], rows: int, cols: int, add) -> np.ndarray:
    """The sum of what ``add(sums, batch)`` makes of all batches of documents, rows x cols.

    Each task has one array and hands it on in slices, compressed; slices are summed where they meet, and the driver
    gets one array of fixed size.
    """
    size = -(-rows // _SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((rows, cols), np.float32)
        for b in batches:
            add(sums, b)
        for i in range(_SLICES):
            part = sums[i * size : (i + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_packed(part)], pa.binary())], ["slice", "part"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _unpacked(pdf["part"].iloc[0]).astype(np.float64)
        for p in pdf["part"].iloc[1:]:
            out += _unpacked(p)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "part": [_packed(out)]})

    made = docs.select(*columns).mapInArrow(run, "slice int, part binary").groupBy("slice").applyInPandas(total, "slice int, part binary").collect()
    out = np.zeros((rows, cols), np.float32)
    for r in made:
        part = _unpacked(r["part"]).reshape(-1, cols)
        out[r["slice"] * size : r["slice"] * size + len(part)] = part
    return out


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """(first, count) of rows of about a million characters together; the text is the last column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False) + 64
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 20_000]), 1 << 20, "right")))
        yield at, n
        at += n


def _sampled(df: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` documents in the order of their hash, as long as they have SAMPLE_CHARS characters together; whole texts."""
    sizes = df.select("doc_id", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    total = F.sum("n").over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1))  # over at most ``most`` rows
    return df.join(F.broadcast(sizes.withColumn("before", total).filter(F.coalesce("before", F.lit(0)) < SAMPLE_CHARS).select("doc_id")), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, subjects: DataFrame, none: str = "none") -> Model:
    """Leanings counted over all documents, classifiers fitted to the bounded sample, thresholds by cross-validation.

    Labels of unknown subjects are ignored; a document labelled none and an area counts as the area; null and empty texts
    aren't used. Without labels every threshold is out of reach. The subjects are a dimension: weights are BITS bits wide times their number.
    """
    spark = docs.sparkSession
    areas = sorted(r.subject for r in subjects.select("subject").distinct().collect() if r.subject and r.subject != none)
    k, width = len(areas), 1 << BITS
    full = docs.filter(F.length("text") > 0).select("doc_id", F.col("text").cast("string").alias("text"))
    tags = labels.filter(F.col("doc_id").isNotNull() & F.col("subject").isin(none, *areas)).groupBy("doc_id").agg(F.collect_set("subject").alias("tags"))
    labelled = sorted(_sampled(full.join(tags, "doc_id"), LABELLED).collect(), key=lambda r: r.doc_id)
    gold_of = {r.doc_id: [a in r.tags for a in areas] for r in labelled}
    gold = np.array(list(gold_of.values()), bool).reshape(-1, k)
    if not len(labelled) or not k:
        return fit([], gold, np.zeros(0, bool), areas, [], None)

    def count_copies(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        grams = Grams()
        for at, n in _pieces(batch):
            doc, rem, feat = grams.read(batch.column(0).slice(at, n).to_pylist())
            sums[:, 0] += np.bincount(_places(_signs(len(doc), rem, feat)), minlength=len(sums)).astype(np.float32)

    every = _summed(full, ["text"], 1 << COPY_BITS, 1, count_copies)[:, 0]
    # the labelled documents again, on the driver: the first leanings, and how sure a leaning must be
    doc, rem, feat = Grams().read([r.text for r in labelled])
    copies = Copies(np.bincount(_places(_signs(len(doc), rem, feat)), minlength=len(every)).astype(np.float32), every)
    mine = Judged(len(labelled), doc, rem, feat, gold, np.ones(len(labelled), bool), copies.weights(len(doc), rem, feat))
    del doc, rem, feat, every
    sums = np.zeros((width + 1, 1 + 2 * k), np.float32)
    mine.add(sums)
    shared = spark.sparkContext.broadcast(copies)
    steps: list[Step] = []
    for number in range(ROUNDS):
        if number:
            so_far = spark.sparkContext.broadcast((steps, gold_of, k))
            sums = _summed(full, ["doc_id", "text"], width + 1, 1 + 2 * k, _counting(so_far, shared))
            so_far.destroy()
        step = Step.of(sums, k)
        del sums
        mine.look(step)
        sure = _sure(mine.top, gold)
        step.sure = min(MOST, sure) if number else sure
        mine.decide(step.sure)
        steps.append(step)
    del mine
    weak = [r.text for r in _sampled(full.join(tags.select("doc_id"), "doc_id", "left_anti"), WEAK).select("text").collect()]
    model = _fitted(spark, [r.text for r in labelled], gold, weak, areas, steps, shared)
    shared.destroy()
    return model


def _counting(share, copies):
    """For ``_summed``: what documents are judged as by the steps so far."""

    def add(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        (steps, gold_of, k), grams = share.value, Grams()
        for at, n in _pieces(batch):
            ids = batch.column(0).slice(at, n).to_pylist()
            doc, rem, feat = grams.read(batch.column(1).slice(at, n).to_pylist())
            known = np.array([i in gold_of for i in ids])
            gold = np.array([gold_of.get(i, [False] * k) for i in ids], bool).reshape(-1, k)
            Judged(n, doc, rem, feat, gold, known, copies.value.weights(len(doc), rem, feat)).follow(steps).add(sums)

    return add


def _fitted(spark, texts: list[str], gold: np.ndarray, weak: list[str], areas: list[str], steps: list[Step], copies) -> Model:
    """The classifiers of the whole sample, and of the sample without each part of the labelled ones, fitted in as many tasks."""
    folds = min(FOLDS, len(texts))
    share = spark.sparkContext.broadcast((texts, gold, weak, areas, steps))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, gold, weak, areas, steps = share.value
        fold = int(pdf["fold"].iloc[0])
        part = np.arange(len(texts)) % folds
        rest, held = np.flatnonzero(part != fold), np.flatnonzero(part == fold)
        m = fit([texts[i] for i in rest] + weak, np.vstack([gold[rest], np.zeros((len(weak), len(areas)), bool)]), np.arange(len(rest) + len(weak)) < len(rest), areas, steps, copies.value)
        if fold >= 0:
            body = (held, m.documents([texts[i] for i in held], Grams()))
        else:
            used = np.flatnonzero(np.abs(m.weights).max(axis=1, initial=0) + np.abs(m.passing) > 0)
            body = (used, m.weights[used], m.bias, m.passing[used], m.passing_bias)
        return pd.DataFrame({"fold": [fold], "body": [pickle.dumps(body)]})

    parts = spark.createDataFrame([(f,) for f in range(-1, folds)], "fold int").repartition(folds + 1, "fold")
    got = {r["fold"]: pickle.loads(r["body"]) for r in parts.groupBy("fold").applyInPandas(run, "fold int, body binary").collect()}
    share.destroy()
    used, weights, bias, passing, passing_bias = got.pop(-1)
    model = Model(areas, np.zeros((1 << BITS, len(areas)), np.float32), bias, np.zeros(1 << BITS, np.float32), passing_bias, np.full(len(areas), 2.0))
    model.weights[used], model.passing[used] = weights, passing
    scores = np.zeros(gold.shape)
    for held, x in got.values():
        scores[held] = x
    model.threshold, f1 = thresholds(scores, gold)
    model.report = {"labelled": len(texts), "f1": f1}
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject) of every area a document is about; null, empty and blank texts have none."""
    used = np.flatnonzero(np.abs(model.weights).max(axis=1, initial=0) + np.abs(model.passing) > 0)
    share = docs.sparkSession.sparkContext.broadcast((model.areas, used, model.weights[used], model.bias, model.passing[used], model.passing_bias, model.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        areas, used, w, bias, pw, pb, threshold = share.value
        weights, passing = np.zeros((1 << BITS, len(areas)), np.float32), np.zeros(1 << BITS, np.float32)
        weights[used], passing[used] = w, pw
        m, grams, names = Model(areas, weights, bias, passing, pb, threshold), Grams(), pa.array(areas, pa.string())
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at, n in _pieces(b):
                d, a = np.nonzero(m.documents(texts.slice(at, n).to_pylist(), grams) >= threshold)
                if len(d):
                    yield pa.RecordBatch.from_arrays([ids.slice(at, n).take(pa.array(d)), names.take(pa.array(a))], ["doc_id", "subject"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("_text")).mapInArrow(run, f"doc_id {kind}, subject string")
