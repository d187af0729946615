"""Byte-level BPE of whole texts with a public vocabulary, exact merges in linear time.

A text is cut by the vocabulary's pattern; special-token strings are ordinary text. Of each different piece the bytes
are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds every token in it.
Encoding then takes the longest token at each position and backtracks to the next shorter one where two
neighbours could not stand side by side in a BPE result. Whether two tokens may is decided by the merges of
their bytes and memoised; a sequence in which all neighbours may is the one that merging gives.

Texts go through in Arrow batches, every executor holds one automaton per worker, and nothing is shuffled.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that cuts a text before byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Different pieces remembered per worker; longer pieces are encoded each time they occur.
REMEMBERED, LONGEST = 400_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id of a file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.ranks = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.text = {i: t for t, i in self.ranks.items()}
        self.cut = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def merge(self, s: str) -> list[int]:
        """The definition: merge the neighbours of lowest rank, the leftmost first, until none can be."""
        parts = list(s)
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper beginning of this one; -1 if there is none."""
        if (k := self.shorter.get(token)) is None:
            t = self.text[token]
            k = next((i for n in range(len(t) - 1, 0, -1) if (i := self.ranks.get(t[:n])) is not None), -1)
            self.shorter[token] = k
        return k

    def side_by_side(self, a: int, b: int) -> bool:
        if (ok := self.fits.get((a, b))) is None:
            if len(self.fits) >= 4 * REMEMBERED:
                self.fits.clear()
            ok = self.fits[a, b] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return ok

    def piece(self, s: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters of its bytes."""
        if (whole := self.ranks.get(s)) is not None:
            return [whole]
        n = len(s)
        longest = [-1] * n
        size = [0] * n
        for end, (k, i) in self.automaton.iter(s):
            at = end - k + 1
            if k > size[at]:
                longest[at], size[at] = i, k
        out: list[int] = []
        ends: list[int] = []
        dead = bytearray(n + 1)  # no valid rest begins there
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + len(self.text[token])
                if not dead[end] and (not out or self.side_by_side(out[-1], token)):
                    break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                ends.append(at)
                at += len(self.text[token])
                token = longest[at] if at < n else -1
            else:  # step back: the token before must be a shorter one
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary doesn't hold every byte")
                token = self.next_shorter(out.pop())
                at = ends.pop()
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, extend = self.known, out.extend
        for w in self.cut.findall(text):
            ids = known.get(w)
            if ids is None:
                ids = self.piece(w.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(w) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = ids
            extend(ids)
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(load_ranks(path))


def encode_column(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, ids: array<int>) of every row; null and empty texts have an empty list.

    The vocabulary is read from ``folder`` on the executors. Rows keep their order within a partition; repeated rows are
    encoded each, a null id is kept.
    """
    path = os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            at = 0
            while at < len(texts):  # slices, so that no batch of long texts is held as ids at once
                n, size = 0, 0
                while at + n < len(texts) and size < 1 << 20:
                    size += len(texts[at + n].as_py() or "") + 64
                    n += 1
                lists = [enc.encode(t) if t else [] for t in texts.slice(at, n).to_pylist()]
                offsets = np.zeros(n + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, offsets[-1])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, n), ids], [id_col, "ids"])
                at += n

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
