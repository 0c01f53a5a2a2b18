"""Measures of how well a reading matches a reference, as columns over normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .fuzzy import lcs_column
from .text import normal, words

FLOOR, FUZZY = 0.5, 0.8


def nls(pred: Column, ref: Column) -> Column:
    """1 less the edit distance over the longer length; 1 if both are empty, 0 if one is."""
    p, r = normal(pred), normal(ref)
    longest = F.greatest(F.char_length(p), F.char_length(r))
    return F.when((p == "") & (r == ""), 1.0).when((p == "") | (r == ""), 0.0).otherwise(1.0 - F.levenshtein(p, r) / longest)


def anls(pred: Column, ref: Column, floor: float = FLOOR) -> Column:
    """``nls``, and 0 below the floor."""
    score = nls(pred, ref)
    return F.when(score >= floor, score).otherwise(0.0)


def cer(pred: Column, ref: Column) -> Column:
    """Edit distance over the reference's length; it can be above 1."""
    p, r = normal(pred), normal(ref)
    return F.when(r != "", F.levenshtein(p, r) / F.char_length(r)).otherwise(F.when(p == "", 0.0).otherwise(1.0))


def _bound(pred: Column, ref: Column, body) -> Column:
    """``body(p, r)`` over both word lists. They are bound once: what stands inside a lambda is worked out at each step."""
    pair = F.struct(words(normal(pred)).alias("p"), words(normal(ref)).alias("r"))
    return let(pair, lambda x: body(x["p"], x["r"]))


def as_letters(pred: Column, ref: Column) -> tuple[Column, Column]:
    """Both word lists as strings in which each distinct word is one private character, so that built-in functions
    on strings work on words. Up to 6,400 distinct words."""
    known = F.array_distinct(F.concat(pred, ref))

    def letters(ws: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xDFFF), 4, "0")), "UTF-16BE")), "")

    return letters(pred), letters(ref)


def wer(pred: Column, ref: Column) -> Column:
    """Edit distance in words over the reference's number of them."""

    def body(p: Column, r: Column) -> Column:
        a, b = as_letters(p, r)
        return F.when(F.size(r) > 0, F.levenshtein(a, b) / F.size(r)).otherwise(F.when(F.size(p) == 0, 0.0).otherwise(1.0))

    return _bound(pred, ref, body)


def rouge_l(pred: Column, ref: Column) -> Column:
    """F1 of the longest common subsequence of words."""

    def body(p: Column, r: Column) -> Column:
        total = F.size(p) + F.size(r)
        # 2PR / (P + R) with P = c / size(p), R = c / size(r)
        return F.when((F.size(p) == 0) | (F.size(r) == 0), 0.0).otherwise(2.0 * lcs_column(p, r) / total)

    return _bound(pred, ref, body)


def _grams(ws: Column, n: int) -> Column:
    last = F.size(ws) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def _clipped(a: Column, b: Column):
    """How often an n-gram counts: as often as it is in both."""
    return lambda g: F.least(F.size(F.filter(a, lambda x: x == g)), F.size(F.filter(b, lambda x: x == g)))


def bleu(pred: Column, ref: Column, most: int = 4) -> Column:
    """Sentence BLEU with 1 added above and below for each order, and a brevity penalty whose base is 2.718281828."""

    def body(p: Column, r: Column) -> Column:
        score = F.lit(1.0)
        for n in range(1, most + 1):
            grams = F.struct(_grams(p, n).alias("a"), _grams(r, n).alias("b"))
            overlap = let(grams, lambda g: F.aggregate(F.transform(F.array_distinct(g["a"]), _clipped(g["a"], g["b"])), F.lit(0), lambda s, x: s + x))
            score = score * ((overlap + 1) / (F.greatest(F.size(p) - n + 1, F.lit(1)) + 1))
        brevity = F.when(F.size(p) < F.size(r), F.least(F.lit(1.0), F.pow(F.lit(2.718281828), 1 - F.size(r) / F.size(p)))).otherwise(1.0)
        return F.when((F.size(p) == 0) | (F.size(r) == 0), 0.0).otherwise(F.pow(score, F.lit(1.0 / most)) * brevity)

    return _bound(pred, ref, body)


def prf(tp: Column, predicted: Column, expected: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; null where a denominator is 0, F1 also where either is 0."""
    p, r = F.try_divide(tp, F.nullif(predicted, F.lit(0))), F.try_divide(tp, F.nullif(expected, F.lit(0)))
    return p, r, F.when((p > 0) & (r > 0), 2 * p * r / (p + r))
