"""Free-entered values mapped to the closest entry of a reference list, or to none.

1. *Deduplicate and normalise.* Equal values are one, then values that normalise to the same words are one (NFKC, look-alike
   letters, camel case, lower case), so a value that a third of all rows carries is looked up once.
2. *Candidates* come from inverted indexes of character n-grams: padded bigrams of the words of the list, and of its forms
   written as one word. What is within the allowed edits of a word shares at least ``len + 1 - 3 * edits`` bigrams with it, so
   the bound drops nothing; an entry is a candidate if each of its words has one in the value, or if it is run together there.
3. *Score.* Vectors of trigrams weighted by inverse document frequency. A word of the value counts as the list word that it
   stands for, as far as the two are alike; the rest of it is orthogonal. Words of the value that stand for no word of the
   entry only wrap it and are left out of its vector.
4. The entry of the largest cosine is taken if that reaches COSINE and leads the next other form by MARGIN.

The reference list is a dimension of bounded size (MAX_ENTRIES is enforced); its index is broadcast, once per worker.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.text import nonblank, squeeze
from strataforge.session import shared_dir

MAX_ENTRIES = 100_000
#: Likeness at which a word can stand for another, cosine for acceptance, and its lead over the next.
ACCEPT, COSINE, MARGIN = 0.70, 0.72, 0.03
#: Shortest beginning of a word that stands for it.
SHORTEST = 3

# Cyrillic and Greek letters that look like Latin ones, and the Latin letter each looks like.
LOOKALIKES = str.maketrans("аеорсухікјѕһԁԛԝмтвнАВЕКМНОРСТУХІЈЅοανικρτυχεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxikjshdqwmtbhABEKMHOPCTYXIJSoavikptuxeABEZHIKMNOPTYX")
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def words(text: str) -> list[str]:
    """Lower-case words after NFKC, look-alike letters and camel case are resolved."""
    t = unicodedata.normalize("NFKC", text).translate(LOOKALIKES)
    t = re.sub("[​-‍⁠﻿­]", "", t)
    return [w.lower() for part in _WORD.findall(t) for w in _CAMEL.split(part) if w]


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; most + 1 if larger than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _allowed(n: int) -> int:
    return 0 if n < 4 else 1 if n < 6 else 2 if n < 9 else 3


@lru_cache(1 << 16)
def alike(value: str, word: str) -> float:
    """How well a word of a value stands for a word of an entry, 0 to 1."""
    if value == word:
        return 1.0
    if len(value) >= SHORTEST and len(value) < len(word) and word.startswith(value):
        return 0.8 + 0.15 * len(value) / len(word)
    if value == word + "s":
        return 0.95
    k = _allowed(len(word))
    d = osa(value, word, k)
    return 1 - d / len(word) if d <= k and 1 - d / len(word) >= ACCEPT else 0.0


def _grams(text: str, n: int) -> set[str]:
    padded = f"^{text}$"
    return {padded[i : i + n] for i in range(max(1, len(padded) - n + 1))}


class _Near:
    """Inverted index of the padded bigrams of texts: which can be within their number of edits of another text.

    An edit, or a transposition of neighbours, touches three bigrams at most, so as many but three per edit are shared.
    """

    def __init__(self, texts: list[str], edits: list[int]):
        lists: dict[str, list[int]] = defaultdict(list)
        for k, t in enumerate(texts):
            for g in _grams(t, 2):
                lists[g].append(k)
        self.lists = {g: np.array(x) for g, x in lists.items()}
        self.least = np.array([max(1, len(_grams(t, 2)) - 3 * e) for t, e in zip(texts, edits)], int)
        self.length, self.edits = np.array([len(t) for t in texts], int), np.array(edits, int)
        self.letters = {c: k for k, c in enumerate(sorted({c for t in texts for c in t}))}
        self.counts = np.stack([self._count(t) for t in texts]) if texts else np.zeros((0, 1), np.int16)

    def _count(self, text: str) -> np.ndarray:
        """How often each letter is in a text; the last place has all that no text of the index holds."""
        return np.bincount([self.letters.get(c, len(self.letters)) for c in text], minlength=len(self.letters) + 1).astype(np.int16)

    def __call__(self, text: str, beginning: bool = False) -> list[int]:
        """Places of the texts, with ``beginning`` also of longer ones that may begin with this one."""
        hits = [self.lists[g] for g in _grams(text, 2) if g in self.lists]
        if not hits:
            return []
        n = np.bincount(np.concatenate(hits), minlength=len(self.least))
        near = np.flatnonzero((n >= self.least) & (np.abs(self.length - len(text)) <= self.edits))
        near = near[np.abs(self.counts[near] - self._count(text)).sum(axis=1) <= 2 * self.edits[near]]  # an edit changes two counts at most
        longer = np.flatnonzero((n >= len(_grams(text, 2)) - 1) & (self.length > len(text))) if beginning else near
        return sorted({*near.tolist(), *longer.tolist()})


class Index:
    """The forms of all entries with their words, n-gram indexes and weights."""

    def __init__(self, forms: list[str]):
        self.forms = forms
        self.words = [tuple(words(f)) for f in forms]
        self.vocabulary = sorted({w for ws in self.words for w in ws})
        self.known = frozenset(self.vocabulary)
        count = Counter(g for ws in self.words for g in {g for w in ws for g in _grams(w, 3)})
        idf = {g: math.log(1 + len(forms) / n) for g, n in count.items()}
        self.weight = {w: sum(idf[g] ** 2 for g in _grams(w, 3)) for w in self.vocabulary}
        self.norm = [sum(self.weight[w] for w in ws) for ws in self.words]
        self.whole = ["".join(ws) for ws in self.words]
        self.of_words = _Near(self.vocabulary, [_allowed(len(w)) for w in self.vocabulary])
        long = [i for i, w in enumerate(self.whole) if len(w) >= 6]
        back = ["".join(reversed(ws)) for ws in self.words]
        self.places = long + long
        self.of_whole = _Near([t[i] for t in (self.whole, back) for i in long], [min(3, _allowed(len(self.whole[i]))) for i in self.places])
        self.holding: dict[str, list[int]] = defaultdict(list)
        for i, ws in enumerate(self.words):
            for w in set(ws):
                self.holding[w].append(i)
        self._cached()

    def _cached(self) -> None:
        self.near, self.runs = lru_cache(1 << 16)(self._near_words), lru_cache(1 << 14)(self._near_forms)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("near", "runs")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._cached()

    def _near_words(self, v: str) -> dict[str, float]:
        """Words of the list for which a word of a value can stand, and how well; a word of the list is no misspelling of another."""
        if v in self.known:
            return {v: 1.0}
        near = {self.vocabulary[k] for k in self.of_words(v, len(v) >= SHORTEST)} | ({v[:-1]} & self.known)
        return {w: s for w in sorted(near) if (s := alike(v, w)) >= ACCEPT}

    def _near_forms(self, run: str) -> set[int]:
        """Forms that can be meant by a word in which they are run together, in either order of their words."""
        return {self.places[k] for k in self.of_whole(run)}

    def _spelled(self, near: list[dict[str, float]], i: int) -> float:
        """Cosine of the words of a value, each as what it stands for, with an entry; 0 unless every word of it is found."""
        entry = self.words[i]
        if len(near) < len(entry):
            return 0.0
        used, total = set(), 0.0
        for w in sorted(entry, key=len, reverse=True):
            s, k = max(((x.get(w, 0.0), -k) for k, x in enumerate(near) if -k not in used), default=(0.0, 0))
            if s < ACCEPT:
                return 0.0
            used.add(k)
            total += s * self.weight[w]
        return total / self.norm[i]

    def _run_together(self, value: tuple[str, ...], runs: set[str], i: int) -> float:
        whole, best = self.whole[i], 0.0
        most = min(3 if any(w in self.words[i] for w in value) else 2, _allowed(len(whole)))
        for run in runs:
            if abs(len(run) - len(whole)) <= most and len(whole) >= 6:
                for form in {whole, "".join(reversed(self.words[i]))}:
                    d = osa(run, form, most)
                    if d <= most:
                        best = max(best, (1 - d / len(form)) * 0.99)
        return best

    def candidates(self, value: tuple[str, ...], near: list[dict[str, float]], runs: set[str]) -> set[int]:
        """Every entry whose cosine can be above 0: by an exact bound, without a cap."""
        found = {w for x in near for w in x}
        have = Counter(i for w in found for i in self.holding[w])
        out = {i for i, n in have.items() if n == len(set(self.words[i]))}
        return out.union(*(self.runs(r) for r in runs))

    def map(self, value: tuple[str, ...]) -> tuple[str | None, float, float]:
        """(form or None, cosine, lead over the next other form) of the normalised words of a value."""
        if not value or not self.forms:
            return None, 0.0, 0.0
        near = [self.near(v) for v in value]
        runs = {v for v in value if v not in self.known} | ({"".join(value)} if any(v not in self.known for v in value) else set())
        scored = sorted((-max(self._spelled(near, i), self._run_together(value, runs, i)), i) for i in self.candidates(value, near, runs))
        scored = [(-s, i) for s, i in scored if s < 0]
        if not scored:
            return None, 0.0, 0.0
        best, i = scored[0]
        lead = best - next((s for s, k in scored[1:] if self.words[k] != self.words[i]), 0.0)
        return (self.forms[i] if best >= COSINE and lead >= MARGIN else None), best, lead


def map_values(values: DataFrame, column: str, forms: list[str]) -> DataFrame:
    """Distinct values of a column with (form, cosine, lead); form is null for unmatched values.

    Null and blank values are left out; a value without a letter or digit is unmatched. forms: names and aliases of the
    reference list. Both functions are declared nondeterministic: else the optimiser evaluates them below the aggregates
    that are there so that they run once per value.
    """
    if len(forms) > MAX_ENTRIES:
        raise ValueError(f"the reference list has {len(forms)} forms; the index is built for up to {MAX_ENTRIES}")
    spark = values.sparkSession
    share = spark.sparkContext.broadcast(Index(sorted(set(forms))))

    @F.pandas_udf("string")
    def normalised(s: pd.Series) -> pd.Series:
        return s.map(lambda x: " ".join(words(x)))

    @F.pandas_udf("form string, cosine double, lead double")
    def mapped(s: pd.Series) -> pd.DataFrame:
        index = share.value
        return pd.DataFrame([index.map(tuple(x.split())) for x in s], columns=["form", "cosine", "lead"])

    # a stated number of partitions, by other than the grouping key (else it is dropped as done already): few bytes are
    # many lookups, so they aren't to be coalesced into one task
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    once = values.filter(nonblank(F.col(column))).select(column).distinct().repartition(tasks, F.xxhash64(column))
    keyed = once.select(column, normalised.asNondeterministic()(F.col(column)).alias("_key"))
    shared_dir(spark)
    keyed = keyed.checkpoint()  # read on both sides of the join
    keys = keyed.select("_key").distinct().repartition(tasks, F.xxhash64("_key"))
    found = keys.select("_key", mapped.asNondeterministic()(F.col("_key")).alias("m"))
    return keyed.join(found, "_key").select(column, "m.*")


def alias_terms(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """(alias_id, term_id) of p6_found: -1 where a row means no entry.

    A row counts unless alias and canonical are both blank. Of entries with the same name the one of the row's kind is
    meant, else the smallest term_id; an alias means the entry that lists it.
    """
    known = terms.filter(F.col("term_id").isNotNull()).select("term_id", squeeze(F.lower("kind")).alias("term_kind"), F.explode(F.concat(F.array("canonical"), F.coalesce("known_aliases", F.array().cast("array<string>")))).alias("form"))
    known = known.filter(nonblank(F.col("form"))).distinct()
    forms = [r.form for r in known.select("form").distinct().limit(MAX_ENTRIES + 1).collect()]  # the reference list: bounded, checked in map_values
    placeholder = F.lower(squeeze(F.col("canonical"))).isin("-", "?", "tbd")
    rows = entries.filter(nonblank(F.col("alias")) | nonblank(F.col("canonical"))).select(
        "alias_id", squeeze(F.lower("kind")).alias("kind"), F.when(nonblank(F.col("canonical")) & ~placeholder, F.col("canonical")).otherwise(F.col("alias")).alias("value")
    )
    mapped = map_values(rows, "value", forms)
    by_kind = known.groupBy("form", "term_kind").agg(F.min("term_id").alias("term_of_kind"))
    by_form = known.groupBy("form").agg(F.min("term_id").alias("term_any"))
    hit = mapped.filter(F.col("form").isNotNull()).select("value", "form").join(F.broadcast(by_form), "form")
    out = rows.join(hit, "value", "left").join(F.broadcast(by_kind.withColumnRenamed("term_kind", "kind")), ["form", "kind"], "left")
    return out.select("alias_id", F.coalesce("term_of_kind", "term_any", F.lit(-1)).alias("term_id"))
