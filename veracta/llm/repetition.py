"""Quality rules by repetition coverage: how much of a text stands inside n-grams or lines that occur more than once.

Rolling hashes of several n-gram lengths are taken over whole batches in
numpy. A character of a word is covered at a length if its word is in an n-gram
of that length that the text has twice or more; a line is covered if an equal
one stands before it.

The base counts are exact up to collisions of 64-bit hashes. A text that is null, empty or
without a word has zero counts, fails the base rule, and is not kept. Repeated
rows and ids stay; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

#: Largest share of word characters inside repeated n-grams of each length, and of line characters in repeated lines.
LIMITS = {5: 0.30, 6: 0.28, 8: 0.25, 10: 0.20}
LINE_LIMIT = 0.30
#: Symbols for each word, at most.
SYMBOL_LIMIT = 0.10
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated(values: np.ndarray, doc: np.ndarray, earlier: bool = False) -> np.ndarray:
    """Whether each value occurs more than once in its text; ``earlier``: whether an equal one stands before it."""
    out = np.zeros(len(values), bool)
    if not len(values):
        return out
    # stable: equal values stay in their order
    one = doc[0] == doc[-1]
    order = np.argsort(values, kind="stable") if one else np.lexsort((values, doc))
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    if not one:
        ordered = doc[order]
        same &= ordered[1:] == ordered[:-1]
    out[order[1:]] |= same
    if not earlier:
        out[order[:-1]] |= same
    return out


def covered(hashed: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which words stand in an n-gram that their text has twice or more."""
    grams, at = tb.ngrams(hashed, doc, n)
    hit = at[repeated(grams, doc[at])]
    marks = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(marks, hit, 1)
    np.subtract.at(marks, hit + n, 1)
    return np.cumsum(marks[:-1]) > 0


def measures(texts: tb.Texts) -> dict[str, np.ndarray]:
    n = len(texts)
    words = tb.words(texts)
    hashed = tb.hashes(texts, words)
    size = tb.characters(texts, words.end) - tb.characters(texts, words.start)
    out = {"n_words": np.bincount(words.doc, minlength=n), "word_chars": tb.totals(size, words.doc, n)}
    at = np.flatnonzero(_SYMBOL[texts.data])
    out["n_symbols"] = np.bincount(np.searchsorted(texts.bounds, at, "right") - 1, minlength=n)

    lines = tb.runs(texts.data != 10, texts)
    # a line with a word: one whose bytes hold the start of a word
    has = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    lines = tb.Spans(lines.start[has], lines.end[has], lines.doc[has])
    line_size = tb.characters(texts, lines.end) - tb.characters(texts, lines.start)
    again = repeated(tb.hashes(texts, lines), lines.doc, earlier=True)
    out["n_dup_lines"] = np.bincount(lines.doc[again], minlength=n)
    whole = np.maximum(tb.totals(line_size, lines.doc, n), 1)
    out["line_coverage"] = tb.totals(line_size[again], lines.doc[again], n) / whole

    inside = covered(hashed, words.doc, WINDOW)
    out["n_repeat_words"] = np.bincount(words.doc[inside], minlength=n)
    for k in LIMITS:
        own = inside if k == WINDOW else covered(hashed, words.doc, k)
        out[f"coverage_{k}"] = tb.totals(size[own], words.doc[own], n) / np.maximum(out["word_chars"], 1)
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["line_coverage", *(f"coverage_{k}" for k in LIMITS)]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, texts in tb.slices(batch.column(1)):
            got = measures(texts)
            cols = [pa.array(got[c].astype(np.int64)) for c in COUNTS] + [pa.array(got[c]) for c in SHARES]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], names=["doc_id", *COUNTS, *SHARES])


def quality(docs: DataFrame) -> DataFrame:
    """For each row: ``doc_id``, the base counts, ``base_failed``, ``kept``, and the shares that the verdict rests on."""
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in SHARES)])
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run, schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    bad = (F.col("line_coverage") > LINE_LIMIT) | (F.col("n_symbols") > SYMBOL_LIMIT * F.col("n_words"))
    for k, most in LIMITS.items():
        bad = bad | (F.col(f"coverage_{k}") > most)
    return found.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~bad).alias("kept"), *SHARES)
