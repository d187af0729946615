"""Text functions as Column expressions; only NFKC, which Spark lacks, is Python (Arrow batches)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Edges are trimmed of every Unicode white space, not of the blank alone.
_EDGE = r"(?U)^\s+|\s+$"
_SPACES = r"(?U)\s+"

# Full-width punctuation and its ASCII form, in the same order.
CJK_PUNCTUATION = "，。：；（）"
ASCII_PUNCTUATION = ",.:;()"

# Wordings that mean the same, rewritten in this order.
SYNONYMS = (("修正", "修复"), ("调整", "优化"), ("接入", "新增"), ("引入", "新增"))


def squeeze(c: Column) -> Column:
    """Without white space at either edge."""
    return F.regexp_replace(c, _EDGE, "")


def nonblank(c: Column) -> Column:
    """True for text with something other than white space; false for null."""
    return F.coalesce(F.length(squeeze(c)) > 0, F.lit(False))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    return _nfkc(c)


def ascii_lower(c: Column) -> Column:
    """Only A to Z change; other scripts keep their case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(c: Column) -> Column:
    """Distinct runs of ASCII letters, digits and underscores of the lower-cased text, first occurrence first."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), 1))


def signal_tokens(c: Column) -> Column:
    """As ``tokens``, with hyphen, underscore and slash as separators."""
    return tokens(F.translate(c, "-_/", "   "))


def phrase(c: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def contains_phrase(haystack: Column, needle: Column) -> Column:
    """Whole-word containment of one normalised phrase in another; an empty needle is nowhere."""
    h, n = phrase(haystack), phrase(needle)
    return (n != "") & F.contains(F.concat(F.lit(" "), h, F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" ")))


def word_pattern(words: list[str]) -> str:
    """A pattern for any of the words as a whole; Java, RE2 and CPython agree on it in every script."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])"


def normalise_text(c: Column, numbers: bool = False) -> Column:
    """NFKC, ASCII punctuation, single blanks, ASCII lower case, synonyms, optionally digit runs as <NUM>.

    Null stays null; blank text becomes the empty string.
    """
    out = F.regexp_replace(F.translate(nfkc(c), CJK_PUNCTUATION, ASCII_PUNCTUATION), _SPACES, " ")
    out = ascii_lower(out)
    for old, new in SYNONYMS:
        out = F.replace(out, F.lit(old), F.lit(new))
    if numbers:
        out = F.regexp_replace(out, r"(?<![\p{L}\p{N}_])\d+(\.\d+)?(?![\p{L}\p{N}_])", "<NUM>")
    return F.trim(out)
