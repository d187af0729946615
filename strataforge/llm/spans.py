"""Long exact spans that rows share: relative Lempel-Ziv factors against indexed reference blocks.

A row's text is shared where MIN or more characters of it also occur in a text of another owner.

1. *Index.* Every window of MIN characters has one seed, its smallest K-gram hash (leftmost on ties), so equal windows have
   equal seeds wherever they stand. The windows of one seed form a block, about 70 of them in 270 characters; neighbouring
   blocks of one seed are one block. Only seeds of two owners can carry a shared window: their hashes are set in a bitmap of
   fixed size, and in a second reading of the corpus the blocks whose seed is in it are taken out with their position.
   (The bitmap may let others through; they meet no block of another owner.)
2. *Reference blocks.* Equal blocks are one, with a place of the smallest and of the largest owner, so a passage that a third
   of all rows holds is compared once.
3. *Parse.* Each block is factored greedily, from its left, against every reference block of its seed: the seed stands at
   a known place in both, so the longest match through it is how far the two agree to its left and to its right. The factor
   that begins first and goes on longest is taken; at its border the references that go on beyond it are tried, the one
   that begins first next, and so on. Factors of MIN or more characters stay, as (reference place, start, stop). A
   window lies in exactly one block, so nothing is lost where blocks meet.
4. Factors of a row are united, so each position counts once.

A seed with more than MOST different blocks, or one that recurs within a block (repetitive text), is parsed window by window
instead: windows are matched by 128-bit fingerprints in a Spark aggregation, which takes any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.session import shared_dir

MIN, K = 200, 64
#: Different blocks of one seed that are parsed against each other, and of one task.
MOST, PER_TASK = 1_000, 20_000
#: Bits of the seed bitmap (2 ** 26: 8 MB), and of a slice of it.
MAP_BITS, SLICE_BITS = 26, 20
_BITS = 22
_BLOCK = 1 << 20
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _symbols(codes: np.ndarray, base: int) -> np.ndarray:
    x = (codes.astype(np.uint64) + _U(0x5851F42D)) * _U(base)
    x ^= x >> _U(29)
    return x * _U(0xBF58476D1CE4E5B9)


def _grams(codes: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hash mod 2^64 of every gram of that length, by doubling."""
    power, mask = base | 1, (1 << 64) - 1
    h, have, done, at = _symbols(codes, base), 1, None, 0
    while True:
        if length & have:
            if done is None:
                done, at = h, have
            else:  # the longer part comes behind
                n = len(done) - have
                done = done[have:] if n < 0 else h[: len(codes) - at - have + 1] * _U(pow(power, at, 1 << 64)) + done[have:]
                at += have
        if at == length:
            return done
        h = h[:-have] * _U(pow(power, have, 1 << 64) & mask) + h[have:]
        have *= 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, have = x, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = MIN, k: int = K):
    """Blocks of the texts [begin, end) of ``codes``: (text no, anchor hash, first window, windows, anchor).

    Windows lie within one text; a text shorter than ``least`` has none.
    """
    ok = end - begin >= least
    if len(codes) < least or not ok.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    h = _mixed(_grams(codes, k, _BASES[0]))
    low = _U((1 << _BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    best = (_sliding_min(key, least - k + 1) & low).astype(np.int64)
    step = np.zeros(len(best) + 1, np.int32)
    np.add.at(step, begin[ok], 1)
    np.add.at(step, end[ok] - least + 1, -1)
    at = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    a = best[at]
    head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    count = np.diff(np.r_[head, len(a)])
    first, anchor = at[head], a[head]
    return np.searchsorted(begin, first, "right") - 1, h[anchor], first, count, anchor


def _decode(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """UTF-8 bytes as code points, and the number of characters before each byte (None: as many as bytes)."""
    if not len(raw) or raw.max() < 128:
        return raw, None
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), before


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Blocks of the texts of each batch, piece by piece: (row_id, owner, no, seed hash, first, windows, seed place or -1, text, first in it).

    The place is that of the seed in the block, -1 if the block has it more than once.
    """
    for batch in batches:
        lists = batch.column("texts")
        offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
        values = lists.values
        spans = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None and len(values) else np.zeros(0, np.uint8)
        ids, owners = batch.column("row_id").to_numpy(), batch.column("owner").to_numpy()
        empty = np.asarray(lists.is_null())
        sizes = np.where(empty, 0, np.diff(offsets))
        row = np.repeat(np.arange(len(lists)), sizes)
        no = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        value = np.repeat(offsets[:-1], sizes) + no
        b, e = spans[value], spans[value + 1]
        keep = e - b >= MIN  # bytes; never fewer than characters
        row, no, b, e = row[keep], no[keep], b[keep], e[keep]
        i = 0
        while i < len(b):
            j = max(i + 1, int(np.searchsorted(np.cumsum(e[i:] - b[i:]), _BLOCK, "right")) + i)
            piece = data[b[i] : e[i]] if j == i + 1 else np.concatenate([data[x:y] for x, y in zip(b[i:j], e[i:j])])
            codes, before = _decode(piece)
            edge = np.r_[0, np.cumsum(e[i:j] - b[i:j])]
            edge = edge if before is None else before[edge]
            lo, hi = edge[:-1], edge[1:]
            for x in range(0, max(1, len(codes)), _BLOCK * 2):  # one very long text is taken in parts that overlap
                y = min(len(codes), x + _BLOCK * 2 + MIN - 1)
                t, h, first, count, seed = anchors(codes[x:y], np.clip(lo - x, 0, y - x), np.clip(hi - x, 0, y - x))
                if not len(t):
                    continue
                same = (t[1:] == t[:-1]) & (h[1:] == h[:-1]) & (first[1:] == first[:-1] + count[:-1])
                head = np.flatnonzero(np.r_[True, ~same])
                many = np.diff(np.r_[head, len(t)]) > 1
                count = np.add.reduceat(count, head)
                t, h, first = t[head], h[head], first[head]
                place = np.where(many, -1, seed[head] - first)
                yield ids[row[i:j][t]], owners[row[i:j][t]], no[i:j][t], h.view(np.int64), first + x - lo[t], count, place, codes, first + x
            i = j


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, owner), once per piece of a batch."""
    for _, owner, _, h, *_ in _scan(batches):
        both = np.unique(np.stack([h, owner], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["h", "owner"])


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The low bits of the hashes as a bitmap of fixed size: made in slices by the tasks, put together on the driver."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << SLICE_BITS, bool)
        bits[pdf["bit"].to_numpy() & ((1 << SLICE_BITS) - 1)] = True
        return pd.DataFrame({"slice": [int(pdf["bit"].iloc[0]) >> SLICE_BITS], "bits": [np.packbits(bits).tobytes()]})

    bit = F.col("h").bitwiseAND(F.lit((1 << MAP_BITS) - 1)).cast("int")
    made = seeds.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", SLICE_BITS)).applyInPandas(packed, "slice int, bits binary")
    out = np.zeros((1 << (MAP_BITS - SLICE_BITS), (1 << SLICE_BITS) // 8), np.uint8)
    for r in made.collect():  # at most 64 slices of 128 KB
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


_PLACED = "row_id long, owner long, no int, h long, first int, place int, block string"


def _blocks(share):
    """Blocks whose seed is in the bitmap, with their text."""
    names = [x.split()[0] for x in _PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = share.value
        for row_id, owner, no, h, first, count, place, codes, at in _scan(batches):
            low = h & ((1 << MAP_BITS) - 1)
            hit = np.flatnonzero((bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1)
            if not len(hit):
                continue
            text = codes.tobytes().decode("ascii" if codes.itemsize == 1 else "utf-32-le")
            size = 0
            cuts = [0]
            for k, n in enumerate(count[hit]):  # many long blocks are handed on in parts
                size += int(n) + MIN
                if size > 1 << 24:
                    cuts.append(k + 1)
                    size = 0
            for lo, hi in zip(cuts, [*cuts[1:], len(hit)]):
                part = hit[lo:hi]
                if len(part):
                    block = pa.array([text[a : a + n + MIN - 1] for a, n in zip(at[part].tolist(), count[part].tolist())], pa.string())
                    cols = [pa.array(row_id[part]), pa.array(owner[part]), pa.array(no[part].astype(np.int32)), pa.array(h[part]), pa.array(first[part].astype(np.int32)), pa.array(place[part].astype(np.int32)), block]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


_REF = [f"{r}_{c}" for r in ("lo", "hi") for c in ("owner", "row", "no", "at")]
_FOUND = "v1 long, v2 long, start int, stop int, " + ", ".join(f"{c} {'long' if c.endswith(('owner', 'row')) else 'int'}" for c in _REF)


def _agree(rows: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    """How many leading codes of row i each row has too."""
    unlike = rows != rows[i]
    n = np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1])
    return np.minimum(n, np.minimum(length, length[i]))


def parse(blocks: list[str], place: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Factors (block, start, stop, reference block) of blocks with one seed, each at its place; lo and hi are their owners."""
    n = len(blocks)
    codes = [np.frombuffer(b.encode("utf-32-le"), np.uint32) for b in blocks]
    left = np.array(place)
    right = np.array([len(c) for c in codes]) - left
    to_left, to_right = np.zeros((n, int(left.max(initial=0)) + 1), np.uint32), np.zeros((n, int(right.max(initial=0)) + 1), np.uint32)
    for k, c in enumerate(codes):
        to_left[k, : left[k]], to_right[k, : right[k]] = c[: left[k]][::-1], c[left[k] :]
    out = []
    for k in range(n):
        if lo[k] != hi[k]:  # the whole block stands with another owner
            out.append((k, 0, len(codes[k]), k))
            continue
        other = np.flatnonzero((lo != lo[k]) | (hi != lo[k]))
        if not len(other):
            continue
        before, after = _agree(to_left, left, k)[other], _agree(to_right, right, k)[other]
        order = np.lexsort((-after, -before))  # the factor that begins first, and of these the longest
        reach = after[order]
        beyond = reach > np.r_[-1, np.maximum.accumulate(reach)[:-1]]  # at a border, those that go on
        for m in order[beyond & (before[order] + reach >= least)]:
            out.append((k, int(left[k] - before[m]), int(left[k] + after[m]), int(other[m])))
    return out


def _factors(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("h", kind="stable").reset_index(drop=True)
    h = pdf["h"].to_numpy()
    lo, hi, place = (pdf[c].to_numpy() for c in ("lo_owner", "hi_owner", "place"))
    at = {c: pdf[c].to_numpy() for c in _REF}
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else []
    rows: list[tuple[int, int, int, int]] = []
    for b, e in zip(head, [*head[1:], len(h)]):
        if lo[b:e].min() != hi[b:e].max():
            rows += [(b + k, x, y, b + m) for k, x, y, m in parse(pdf["block"].iloc[b:e].tolist(), place[b:e], lo[b:e], hi[b:e], MIN)]
    k, x, y, m = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
    out = {"v1": pdf["v1"].to_numpy()[k], "v2": pdf["v2"].to_numpy()[k], "start": x, "stop": y}
    # where the factor begins in the reference block: as far from the seed as in its own
    shift = x - place[k] + place[m]
    out |= {c: at[c][m] + shift if c.endswith("_at") else at[c][m] for c in _REF}
    return pd.DataFrame(out)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of all windows of blocks."""
    for batch in batches:
        for i in range(len(batch)):
            codes = np.frombuffer(batch.column("block")[i].as_py().encode("utf-32-le"), np.uint32)
            p, q = (_grams(codes, MIN, base).view(np.int64) for base in _BASES)
            n = len(p)
            copy = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(n, np.int64))) for c in ("v1", "v2", *_REF)]
            yield pa.RecordBatch.from_arrays([*copy, pa.array(np.arange(n, dtype=np.int32)), pa.array(p), pa.array(q)], ["v1", "v2", *_REF, "start", "p", "q"])


def _by_window(blocks: DataFrame) -> DataFrame:
    """The factors of blocks by fingerprints of their windows: each window that another owner has too."""
    schema = "v1 long, v2 long, " + ", ".join(_FOUND.split(", ")[4:]) + ", start int, p long, q long"
    windows = blocks.select("v1", "v2", *_REF, "block").mapInArrow(_windows, schema)
    ref = lambda r: F.struct(*(F.col(f"{r}_{c}").alias(c) for c in ("owner", "row", "no")), (F.col(f"{r}_at") + F.col("start")).alias("at"))
    both = windows.groupBy("p", "q").agg(F.min(ref("lo")).alias("lo"), F.max(ref("hi")).alias("hi")).filter("lo.owner <> hi.owner")
    flat = [F.col(f"{r}.{c}").alias(f"{r}_{c}") for r in ("lo", "hi") for c in ("owner", "row", "no", "at")]
    return windows.select("v1", "v2", "start", "p", "q").join(both, ["p", "q"]).select("v1", "v2", "start", (F.col("start") + MIN).cast("int").alias("stop"), *flat)


def shared_spans(rows: DataFrame) -> DataFrame:
    """(row_id, owner, texts: array<string>) -> factors (row_id, no, start, stop, ref_row, ref_no, ref_start).

    Characters [start, stop) of text ``no`` stand verbatim in text ``ref_no`` of row ``ref_row``, of another owner, from
    ``ref_start`` on. owner is any 64-bit value, equal for rows that don't count as others; row_id is unique. Null and short
    texts have no factor; the same text twice in one row is no other occurrence.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    seeds = rows.mapInArrow(_seeds, "h long, owner long").groupBy("h").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).filter("lo <> hi")
    share = spark.sparkContext.broadcast(_bitmap(seeds))
    placed = rows.mapInArrow(_blocks(share), _PLACED)
    placed = placed.select("*", F.xxhash64("block").alias("v1"), F.xxhash64(F.lit(1), "block").alias("v2")).checkpoint()  # the corpus isn't read a third time
    at = F.struct(F.col("owner"), F.col("row_id").alias("row"), F.col("no"), F.col("first").alias("at"))
    merged = placed.groupBy("h", "v1", "v2").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.first("block").alias("block"), F.first("place").alias("place"))
    flat = [F.col(f"{r}.{c}").alias(f"{r}_{c}") for r in ("lo", "hi") for c in ("owner", "row", "no", "at")]
    blocks = merged.select("h", "v1", "v2", *flat, "block", "place").checkpoint()
    n, repeats = blocks.agg(F.count("*"), F.coalesce(F.bool_or(F.col("place") < 0), F.lit(False))).first()
    usual, crowded = blocks, None
    if repeats or n > MOST:
        hard = blocks.groupBy("h").agg(F.count("*").alias("n"), F.bool_or(F.col("place") < 0).alias("repeats")).filter((F.col("n") > MOST) | F.col("repeats")).select("h").checkpoint()
        if not hard.isEmpty():
            usual, crowded = blocks.join(hard, "h", "left_anti"), blocks.join(hard, "h", "left_semi")
    tasks = max(1, spark.sparkContext.defaultParallelism, -(-n // PER_TASK))
    found = usual.withColumn("task", F.pmod("h", F.lit(tasks))).groupBy("task").applyInPandas(_factors, _FOUND)
    if crowded is not None:
        found = found.unionByName(_by_window(crowded))
    own = F.col("owner") == F.col("lo_owner")
    ref = [F.when(own, F.col(f"hi_{c}")).otherwise(F.col(f"lo_{c}")).alias(a) for c, a in (("row", "ref_row"), ("no", "ref_no"), ("at", "ref_start"))]
    return placed.select("row_id", "owner", "no", "first", "v1", "v2").join(found, ["v1", "v2"]).select("row_id", "no", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"), *ref)


def union_length(spans):
    """Positions covered by an array of (no, start, stop)."""
    zero = F.struct(F.lit(-1).alias("no"), F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n"))

    def add(acc, s):
        begin = F.when(s["no"] == acc["no"], F.greatest(s["start"], acc["upto"])).otherwise(s["start"])
        upto = F.when(s["no"] == acc["no"], F.greatest(s["stop"], acc["upto"])).otherwise(s["stop"])
        return F.struct(s["no"].alias("no"), upto.alias("upto"), (acc["n"] + F.greatest(s["stop"] - begin, F.lit(0))).alias("n"))

    return F.aggregate(F.sort_array(spans), zero, add, lambda acc: acc["n"])


def shared_chars(rows: DataFrame) -> DataFrame:
    """(row_id, shared_chars) of each row with a factor."""
    spans = F.collect_set(F.struct("no", "start", "stop"))  # of one row: bounded by its own text
    return shared_spans(rows).groupBy("row_id").agg(union_length(spans).alias("shared_chars"))


def commit_texts(commits: DataFrame) -> DataFrame:
    """Commits as rows of texts; the owner is the commit, null being one of its own."""
    return commits.filter(F.col("raw_id").isNotNull()).select(F.col("raw_id").alias("row_id"), F.xxhash64("commit_id").alias("owner"), F.col("diff_chunks").alias("texts"))
