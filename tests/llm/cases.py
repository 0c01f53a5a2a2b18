"""Rows that every operator on texts must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, score double, n_words long"


def odd_rows():
    long = " ".join(f"word{i % 997}x{i}" for i in range(9000))
    rows = [
        (1, None, "en", "a", 0.0, 0), (2, "", "en", "a", 0.0, 0), (3, "   \n\t ", "en", None, 0.0, 0), (4, "one", "en", "a", 0.0, 0), (5, "one", None, "a", 0.0, 0), (6, long, "en", "a", 0.0, 0), (7, long, "en", "b", 0.0, 0),
        (8, "é日本 \U0001f600 ﻿x", "fr", "b", 0.0, 0), (9, "a b c d e f g h i j", "en", "b", 0.0, 0), (9, "a b c d e f g h i j", "en", "b", 0.0, 0), (None, "nobody's text", "en", "c", 0.0, 0), (10, "!" * 3000, "en", "c", 0.0, 0), (11, "x" * 5000, "en", "c", 0.0, 0),
    ]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)
