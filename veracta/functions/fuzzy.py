"""Fuzzy similarities from 0 to 100, by their published definitions.

The plain ratio is the indel similarity: twice the longest common subsequence
over both lengths. The Catalyst form suits short strings; the Arrow form runs
one bit-parallel pass in Python for each pair and suits any.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def lcs(a, b) -> int:
    """Length of the longest common subsequence, a whole row of the table in one integer."""
    if len(a) > len(b):
        a, b = b, a
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The shorter string against every window of its length in the longer one, and against the shorter windows at its ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, m = len(a), len(b)
    windows = {b[max(0, i) : i + n] for i in range(1 - n, m)}
    best = max(ratio(a, w) for w in windows)
    if n == m:
        best = max(best, *(ratio(b, a[max(0, i) : i + n]) for i in range(1 - n, n)))
    return best


def _sets(a: str, b: str) -> tuple[set, set, set]:
    x, y = set(a.split()), set(b.split())
    return x & y, x - y, y - x


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Common words alone, and with either side's others, compared with each other."""
    both, left, right = _sets(a, b)
    if not a.split() or not b.split():
        return 0.0
    if both and (not left or not right):
        return 100.0
    common = " ".join(sorted(both))
    one, two = (" ".join([*([common] if common else []), *([" ".join(sorted(x))] if x else [])]) for x in (left, right))
    scores = [ratio(one, two)]
    if common:
        scores += [ratio(common, one), ratio(common, two)]
    return max(scores)


def partial_token_set_ratio(a: str, b: str) -> float:
    both, left, right = _sets(a, b)
    if not a.split() or not b.split():
        return 0.0
    return 100.0 if both else partial_ratio(" ".join(sorted(left)), " ".join(sorted(right)))


def partial_token_sort_ratio(a: str, b: str) -> float:
    return partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def weighted_ratio(a: str, b: str) -> float:
    """The best of plain, word and partial ratios, with less weight for what ignores more; partial ones only where
    one string is half as long again as the other."""
    if not a or not b:
        return 0.0
    size = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if size < 1.5:
        return max(best, 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    scale = 0.9 if size <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_sort_ratio(a, b), 0.95 * scale * partial_token_set_ratio(a, b))


def cross_check(claimed: str, seen: str) -> float:
    """Of two normal forms: substring or word-set agreement, whichever is better; 0 if one is empty."""
    return max(partial_ratio(claimed, seen), token_set_ratio(claimed, seen)) if claimed and seen else 0.0


_KINDS = {f.__name__: f for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, weighted_ratio, cross_check)}


def similarity(a: Column, b: Column, kind: str = "ratio") -> Column:
    """An Arrow function over two string columns; null if either is."""
    score = _KINDS[kind]

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        known: dict = {}
        out = []
        for pair in zip(left.to_pylist(), right.to_pylist(), strict=True):
            if None in pair:
                out.append(None)
                continue
            if pair not in known:
                known[pair] = score(*pair)
            out.append(known[pair])
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def lcs_column(a: Column, b: Column) -> Column:
    """LCS length in Catalyst: one row of the table after the other. Quadratic; for short strings or arrays of words."""
    # both lists are bound once, or each step would make them anew
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: _lcs_rows(x["a"], x["b"]))


def _lcs_rows(a: Column, b: Column) -> Column:
    zero = F.array_repeat(F.lit(0), F.size(b) + 1)

    def next_row(row: Column, x: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            hit = F.element_at(row, j) + 1
            other = F.greatest(F.element_at(row, j + 1), F.element_at(acc, -1))
            return F.concat(acc, F.array(F.when(F.element_at(b, j) == x, hit).otherwise(other)))

        return F.aggregate(F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), step)

    return F.element_at(F.aggregate(a, zero, next_row), -1)


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def ratio_column(a: Column, b: Column) -> Column:
    """The plain ratio in Catalyst, for short strings."""
    n = F.char_length(a) + F.char_length(b)
    return F.when(n == 0, 100.0).otherwise(200.0 * lcs_column(characters(a), characters(b)) / n)


def can_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether two strings' lengths leave room for that plain ratio: a cheap filter before it, which loses nothing."""
    la, lb = F.char_length(a), F.char_length(b)
    return 200.0 * F.least(la, lb) >= F.lit(threshold) * (la + lb)
