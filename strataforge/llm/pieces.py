"""Oversized texts cut into pieces of at most ``limit`` UTF-8 bytes, between lines wherever that is possible.

Items within the limit are one piece and never leave the JVM. The others go to Arrow batches: byte offsets come from
prefix sums, the boundaries are a sorted array, and each cut is a binary search for the last boundary under the
limit. The next piece steps back by up to ``overlap`` bytes, to a boundary if one is near enough; where no boundary
lies within reach the piece is cut between two characters.

Concatenating the pieces without their overlaps gives the item back, byte for byte.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
_NEWLINE = re.compile(rb"\r?\n")
_PLAN = "array<struct<start: int, stop: int, fresh: int, hard: boolean>>"


def plan(raw: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """(start, stop, fresh, hard) of each piece: bytes [start, stop), of which those before fresh repeat the piece
    before; hard if it ends inside a line. An empty text is one empty piece."""
    if limit < 4 or not 0 <= overlap < limit:
        raise ValueError("limit must hold a character, and overlap be less than limit")
    n = len(raw)
    if n <= limit:
        return [(0, n, 0, False)]
    ends = [(m.start(), m.end()) for m in _NEWLINE.finditer(raw)]
    lines = [e for _, e in ends]
    if not lines or lines[-1] != n:
        lines.append(n)
    tails = [s for s, _ in ends]  # before the line end: the line's content still fits where its end no longer does
    # character boundaries as a prefix sum over leading bytes: a byte begins a character unless it is 10xxxxxx
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    chars = np.append(np.flatnonzero(lead), n)

    def floor_char(at: int) -> int:
        return int(chars[np.searchsorted(chars, at, "right") - 1])

    def ceil_char(at: int) -> int:
        return int(chars[np.searchsorted(chars, at, "left")])

    out, fresh = [], 0
    while fresh < n:
        start = 0
        if fresh:
            start = max(ceil_char(max(0, fresh - overlap)), out[-1][0])
            k = bisect_left(lines, start)
            if k < len(lines) and lines[k] < fresh:
                start = lines[k]  # step back to a line start if one is within the overlap
            k = bisect_right(lines, fresh)
            t = bisect_right(tails, fresh)
            whole = min([x for x in (lines[k] if k < len(lines) else None, tails[t] if t < len(tails) else None) if x is not None and x > fresh])
            if whole - fresh <= limit < whole - start:  # rather less overlap than a line cut in two
                start = ceil_char(whole - limit)
                k = bisect_left(lines, start)
                if k < len(lines) and lines[k] < fresh:
                    start = lines[k]
        most = start + limit
        k, t = bisect_right(lines, most) - 1, bisect_right(tails, most) - 1
        cut = max([x for x in (lines[k] if k >= 0 else 0, tails[t] if t >= 0 and (k < 0 or lines[k] <= fresh) else 0)])
        hard = cut <= fresh
        if hard:
            cut = floor_char(most)
            if cut <= fresh:  # a character doesn't fit behind the overlap
                start, cut = fresh, floor_char(fresh + limit)
        out.append((start, cut, fresh, hard))
        fresh = cut
    return out


def planner(limit: int = LIMIT, overlap: int = OVERLAP):
    """The plan of each text as a pandas UDF."""

    @F.pandas_udf(_PLAN)
    def plans(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else plan(x.encode("utf-8", "surrogatepass"), limit, overlap))

    return plans


def items(commits: DataFrame, id_col: str = "raw_id") -> DataFrame:
    """(id, item_kind, item_no, text): each element of diff_chunks, and the files list joined by line feeds.

    Null chunks keep their position but are no item; a null list is none; null entries of files are left out.
    """
    chunks = F.transform(F.coalesce("diff_chunks", F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("diff_chunks").alias("item_kind"), i.cast("int").alias("item_no"), x.alias("text")))
    files = F.array(F.struct(F.lit("files").alias("item_kind"), F.lit(0).alias("item_no"), F.array_join("files", "\n").alias("text")))
    return commits.select(id_col, F.explode(F.concat(chunks, files)).alias("x")).select(id_col, "x.item_kind", "x.item_no", "x.text").filter(F.col("text").isNotNull())


def planned(rows: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Rows with n_bytes and the plan of their pieces; only oversized texts pass through Python.

    The two kinds are read separately: a UDF in one branch of a CASE is evaluated for every row.
    """
    sized = rows.withColumn("n_bytes", F.octet_length(text))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").alias("stop"), F.lit(0).alias("fresh"), F.lit(False).alias("hard")))
    small = sized.filter(F.col("n_bytes") <= limit).withColumn("pieces", whole.cast(_PLAN))
    large = sized.filter(F.col("n_bytes") > limit).withColumn("pieces", planner(limit, overlap)(F.col(text)))
    return small.unionByName(large)


def oversized(rows: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Only the rows over the limit, with the plan of their pieces."""
    return rows.withColumn("n_bytes", F.octet_length(text)).filter(F.col("n_bytes") > limit).withColumn("pieces", planner(limit, overlap)(F.col(text)))


def has_long_line(pieces: Column) -> Column:
    """A piece ends inside a line only if the line is itself over the limit."""
    return F.exists(pieces, lambda p: p["hard"])


def found(commits: DataFrame) -> DataFrame:
    """(raw_id, item_kind, item_no, case_kind) of p3_found, read off the plans."""
    big = oversized(items(commits)).filter(F.size("pieces") > 1)
    kinds = F.when((F.col("item_kind") == "diff_chunks") & has_long_line(F.col("pieces")), F.array(F.lit("oversized"), F.lit("long_line"))).otherwise(F.array(F.lit("oversized")))
    return big.select("raw_id", "item_kind", "item_no", F.explode(kinds).alias("case_kind"))


def pieces(rows: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keys, piece_no, start_byte, overlap_bytes, hard_cut, piece: every item as its ordered pieces."""
    exploded = planned(rows.select(*keys, F.col(text).alias("_t")), "_t", limit, overlap).select(*keys, F.encode("_t", "UTF-8").alias("_b"), F.posexplode("pieces").alias("piece_no", "p"))
    return exploded.select(
        *keys, "piece_no", F.col("p.start").alias("start_byte"), (F.col("p.fresh") - F.col("p.start")).alias("overlap_bytes"), F.col("p.hard").alias("hard_cut"),
        F.decode(F.substr(F.col("_b"), F.col("p.start") + 1, F.col("p.stop") - F.col("p.start")), "UTF-8").alias("piece"),
    )
