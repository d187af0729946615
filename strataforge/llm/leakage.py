"""Held-out texts that stand in a corpus, whole or in part: windows of words, CGK embedding, bit-sampling LSH.

Both sides become words (NFKC, without zero-width characters, lower case). A window of WINDOW words is embedded by a
random walk that reads a word and, by a random bit of (step, word), stays or goes on: windows at a small edit distance
then agree at most steps. The LSH key of a repeat is a hash of the words read at some sampled steps. Candidates with an
equal key are verified exactly, by the words themselves (``edits`` = 0) or by word edit distance. With ``slack`` the end of a
document's window is free: it may have so many words more or less than the item's, so words added or dropped inside a
passage don't count once more at its end.

Windows that can't match are passed over before they are embedded: with ``edits`` edits, one of edits + 1 equal parts of
the window stands unchanged, so the window must hold that many words in a row as in some item, and an edit parts two pairs
of neighbours at most, so all others must be neighbours in some item. This drops no match. Candidates of several repeats are
verified once: first that one of the parts stands unchanged nearly at its place, then the edit distance, on the diagonals that
so few edits reach.

The items are searched in blocks of about ITEM_CHARS characters, whose index is broadcast; the corpus is read once per block, in
Arrow batches, and isn't shuffled except for the distinct (document, item) pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 16
#: Characters of the items that one index holds; more items are searched block by block, each reading the corpus.
ITEM_CHARS = 20_000_000
_U = np.uint64
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
_PART = 1 << 17  # windows embedded at once


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC, removal of invisible characters and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Embedding:
    """One repeat: a random walk over 3 * window steps and the steps that are sampled."""

    def __init__(self, seed: int, window: int, samples: int):
        rng = np.random.default_rng(seed)
        self.window = window
        self.salts = rng.integers(1, 1 << 63, 3 * window, dtype=np.uint64)
        self.sampled = np.zeros(3 * window, bool)
        # later steps mostly read past the end of the window; the first 2 * window tell windows apart
        self.sampled[rng.choice(2 * window, min(samples, 2 * window), replace=False)] = True
        self.last = int(np.flatnonzero(self.sampled)[-1])

    def keys(self, w: np.ndarray) -> np.ndarray:
        """w: rows of word hashes -> one LSH key per row."""
        n, width = w.shape
        w = np.hstack([w, np.zeros((n, 1), np.uint64)])  # the pad that is read beyond the end
        at, rows, key = np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.uint64)
        for j in range(self.last + 1):
            x = w[rows, at]
            if self.sampled[j]:
                key = _mix(key * _U(0x9E3779B97F4A7C15) + x + _U(j))
            at = np.minimum(at + (_mix(x ^ self.salts[j]) >> _U(63)).astype(np.int64), width)
        return key


class Items:
    """The index of all windows of the items, one sorted key list per repeat."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW, edits: int = 0, samples: int = 8, repeats: int = 1, seed: int = 7, slack: int = 0):
        if slack and not edits:
            raise ValueError("equal windows are equally long")
        self.window, self.edits, self.slack = window, edits, slack
        self.part = window // (edits + 1)  # words that stand unchanged in a row
        texts = [(i, words(t)) for i, t in sorted(items, key=lambda x: x[0])]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in texts for w in ws))}
        self.hashes = np.array([self.hash(w) for w in self.vocabulary] or [0], np.uint64)
        rows, owner, pairs, grams = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, ws in texts:
            ids = np.array([self.vocabulary[w] for w in ws], np.int64)
            pairs.append(ids[:-1] * len(self.vocabulary) + ids[1:])
            if edits and self.part and len(ids) >= self.part:
                grams.append(self._gram(ids, np.arange(len(ids) - self.part + 1)))
            if len(ids) >= window:
                v = np.lib.stride_tricks.sliding_window_view(ids, window)
                rows.append(v)
                owner += [i] * len(v)
        self.pairs, self.grams = np.unique(np.concatenate(pairs)), np.unique(np.concatenate(grams))
        self.rows = np.vstack(rows) if rows else np.zeros((0, window), np.int64)
        self.owner = np.array(owner, np.int64)
        self.walks = [Embedding(seed + r, window, samples) for r in range(repeats)]
        self.keys = []
        for e in self.walks:
            k = e.keys(self.hashes[self.rows]) if len(self.rows) else np.zeros(0, np.uint64)
            order = np.argsort(k, kind="stable")
            self.keys.append((k[order], order))

    @staticmethod
    def hash(word: str) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))

    def _gram(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the ``part`` words from each place on."""
        key = np.zeros(len(at), np.uint64)
        for j in range(self.part):
            key = _mix(key * _U(0x9E3779B97F4A7C15) + ids[at + j].astype(np.uint64) + _U(j + 1))
        return key

    def _starts(self, ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a long enough run of words neighbouring as in an item."""
        if len(ids) < self.window - self.slack or not len(self.pairs):
            return np.zeros(0, np.int64)
        pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(self.vocabulary) + ids[1:], -1)
        good = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        run = self.part - 1  # neighbouring pairs within an unchanged part
        near = np.r_[0, np.cumsum(good)]
        if run > 0:
            seed = near[run:] - near[:-run] == run
            if self.edits:
                at = np.flatnonzero(seed)
                g = self._gram(ids, at)
                seed[at] = len(self.grams) and self.grams[np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)] == g
        else:
            run, seed = 0, ids >= 0
        total = np.r_[0, np.cumsum(seed)]
        width = self.window + self.slack
        n = len(ids) - self.window + self.slack + 1
        to = lambda c, span: c[np.minimum(np.arange(n) + span, len(c) - 1)]  # noqa: E731  (the last windows end with the text)
        fit = to(total, width - run) > total[np.minimum(np.arange(n), len(total) - 1)]  # a window holds that many places for the part
        if self.edits:
            fit &= to(near, width - 1) - near[np.minimum(np.arange(n), len(near) - 1)] >= self.window - 1 - 2 * self.edits
        return np.flatnonzero(fit & valid[:n])

    def match(self, docs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(document no, item id) pairs, possibly repeated."""
        get = self.vocabulary.get
        lists = [words(t) for t in docs]
        size = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter((get(w, -1) for x in lists for w in x), np.int64, int(size.sum()))
        edge = np.cumsum(size)
        doc = np.repeat(np.arange(len(lists)), size)
        left = np.repeat(edge, size) - np.arange(len(ids))
        starts = self._starts(ids, left >= self.window - self.slack)
        found = []
        if len(starts) and self.edits:
            memo: dict[str, int] = {}
            flat = (w for x in lists for w in x)
            hashes = np.fromiter((memo[w] if w in memo else memo.setdefault(w, self.hash(w)) for w in flat), np.uint64, len(ids))
        for lo in range(0, len(starts), _PART):
            s = starts[lo : lo + _PART]
            at = s[:, None] + np.arange(self.window + self.slack)
            if self.edits:  # nothing is read beyond the end of the document
                inside = at < edge[doc[s]][:, None]
                at = np.minimum(at, len(ids) - 1)
                w, v = np.where(inside, hashes[at], _U(0)), np.where(inside, ids[at], -1).astype(np.int32)
            else:
                w, v = self.hashes[ids[at]], ids[at]
            pairs = []
            for e, (keys, order) in zip(self.walks, self.keys):
                k = e.keys(w)
                a, b = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                n = b - a
                q = np.repeat(np.arange(len(s)), n)
                hit = order[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
                pairs.append(q * len(self.rows) + hit)
            pairs = np.concatenate(pairs) if len(pairs) == 1 else np.unique(np.concatenate(pairs))  # verified once, whatever the repeats
            for x in range(0, len(pairs), _PART):
                q, hit = np.divmod(pairs[x : x + _PART], max(1, len(self.rows)))
                if self.edits:
                    ok = self._part_stands(hit, v[q])
                    q, hit = q[ok], hit[ok]
                    ok = _distance(self.rows[hit].astype(np.int32), v[q], self.edits, self.slack) <= self.edits
                else:
                    ok = (v[q] == self.rows[hit]).all(axis=1)
                q, hit = q[ok], hit[ok]
                if len(q):
                    found.append(np.unique(np.stack([doc[s[q]], self.owner[hit]], 1), axis=0))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = np.unique(np.vstack(found), axis=0)
        return out[:, 0], out[:, 1]

    def _part_stands(self, hit: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether one of the edits + 1 parts of each item window stands unchanged, at most ``edits`` places off."""
        rows, out = self.rows[hit], np.zeros(len(hit), bool)
        for p in range(self.edits + 1):
            lo = p * self.part
            for o in range(-self.edits, self.edits + 1):
                if lo + o < 0 or lo + self.part + o > v.shape[1]:
                    continue
                rest = np.flatnonzero(~out)
                for j in range(lo, lo + self.part):
                    rest = rest[rows[rest, j] == v[rest, j + o]]
                out[rest] = True
        return out


def _distance(a: np.ndarray, b: np.ndarray, most: int, slack: int = 0) -> np.ndarray:
    """Word edit distance of each row of a from the same row of b, or from its start up to a word among the last 2 * slack + 1.

    Exact up to ``most``, more than that beyond: only the diagonals that so few edits can reach are worked out. -1 equals nothing.
    """
    n, m = len(a), b.shape[1]
    far = np.full(n, 100, np.uint8)
    last = {o: np.full(n, o, np.uint8) if 0 <= o <= m else far for o in range(-most - 1, most + 2)}
    last[-most - 1] = last[most + 1] = far
    for i in range(1, a.shape[1] + 1):
        row = {-most - 1: far, most + 1: far}
        for o in range(-most, most + 1):
            j = i + o
            if j < 0 or j > m:
                row[o] = far
            elif j == 0:
                row[o] = np.full(n, i, np.uint8)
            else:
                row[o] = np.minimum(np.minimum(last[o + 1], row[o - 1]) + np.uint8(1), last[o] + (a[:, i - 1] != b[:, j - 1]))
        last = row
    ends = [o for o in range(-most, most + 1) if m - 2 * slack <= a.shape[1] + o <= m]
    return np.minimum.reduce([last[o] for o in ends]) if ends else far


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", item_text: str = "text", window: int = WINDOW, edits: int = 0, samples: int = 8, repeats: int = 1, slack: int = 0) -> DataFrame:
    """Distinct (doc_id, item_id): documents with a window of ``window`` words, up to ``slack`` more or less, within ``edits`` word edits of one of the item's.

    With edits = 0 the result is exact whatever samples and repeats are, since equal windows have equal keys; with more
    it depends on them. Null and empty texts, and items of fewer words than a window, match nothing; repeated documents
    match each, items with the same passage are all reported.
    """
    named = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t"))
    size = named.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ITEM_CHARS))
    out = None
    for k in range(blocks):
        part = named.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k) if blocks > 1 else named
        found = _leaks(docs, [(r.i, r.t) for r in part.collect()], doc_id, item_id, text, window, edits, samples, repeats, slack)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _leaks(docs: DataFrame, listed: list[tuple], doc_id: str, item_id: str, text: str, window: int, edits: int, samples: int, repeats: int, slack: int) -> DataFrame:
    """The leaks of one block of items; its index is made once and read once per worker."""
    share = docs.sparkSession.sparkContext.broadcast(Items(listed, window, edits, samples, repeats, 7, slack))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = share.value
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at = 0
            while at < len(texts):
                n, size = 0, 0
                while at + n < len(texts) and size < 1 << 20:
                    size += len(texts[at + n].as_py() or "") + 64
                    n += 1
                d, i = index.match(texts.slice(at, n).to_pylist())
                if len(d):
                    yield pa.RecordBatch.from_arrays([ids.slice(at, n).take(pa.array(d)), pa.array(i)], [doc_id, item_id])
                at += n

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id), F.col(text).cast("string").alias("_text")).filter(F.length("_text") > 0).mapInArrow(run, f"`{doc_id}` {kind}, `{item_id}` bigint")
