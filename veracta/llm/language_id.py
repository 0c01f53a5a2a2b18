"""Language identification by rank order (out-of-place distance between n-gram profiles).

A profile is the list of a text's most frequent n-grams of one to three
letters, most frequent first; words are framed by a space, and letters are
lower-cased. A language's profile comes from the labelled texts. A text's
distance to a language is the sum, over its own profile, of how far each n-gram
stands from its place there, or the largest distance if it isn't there.

Labelled rows are read up to ``most_train`` of them, those with the least hash
of their id, spread over the languages as they come; every text is
scored whole. A text that is null or has no letter is ``und`` with score 0, as
is every text if nothing was learned. Ties go to the language first in
alphabet. Repeated rows stay, extra columns are ignored, and an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

LENGTH, MOST_TRAIN, LONGEST, WINDOW = 300, 20_000, 3, 1 << 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """For each code point its lower-case letter's code point, or a space's if it is no letter."""
    out = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str, most: int = WINDOW) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of ``text``, each as often as it occurs, from ``most`` characters at a time."""
    held, known = np.array([0x20], np.uint32), 0  # points carried over; how many of them have been counted
    for lo in range(0, len(text), most):
        points = _alphabet()[np.frombuffer(text[lo : lo + most].encode("utf-32-le", "surrogatepass"), np.uint32)]
        points = np.concatenate([held, points, np.full(int(lo + most >= len(text)), 0x20, np.uint32)])
        gap = points == 0x20
        points = points[~(gap & np.append(False, gap[:-1]))]  # one space between words
        rolled = np.zeros(len(points), np.uint32)
        for n in range(1, min(LONGEST, len(points)) + 1):
            rolled = rolled[: len(points) - n + 1] * np.uint32(0x01000193) + (points[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            own = (rolled ^ (rolled >> np.uint32(15)))[max(0, known - n + 1) :]
            yield own[points[known:] != 0x20] if n == 1 else own
        held, known = points[1 - LONGEST :], min(LONGEST - 1, len(points))


def counted(text: str, most: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``text`` and how often each occurs; memory grows with their kinds, not with the text."""
    if len(text) <= most:
        return np.unique(np.concatenate([np.zeros(0, np.uint32), *grams(text, most)]), return_counts=True)
    kinds, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for found in grams(text, most):
        kinds, counts = added([(kinds, counts), np.unique(found, return_counts=True)])
    return kinds, counts


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several counts as one."""
    kinds, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return kinds, tb.totals(np.concatenate([c for _, c in parts]), back, len(kinds))


def profile(kinds: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by hash."""
    if len(counts) > length:  # no kind rarer than the last that fits can be in
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        kinds, counts = kinds[counts >= least], counts[counts >= least]
    return kinds[np.lexsort((kinds, -counts))][:length]


class Profiles:
    """The languages' profiles, ready for look-up."""

    def __init__(self, ranked: dict[str, np.ndarray], length: int = LENGTH):
        self.length, self.langs = length, sorted(ranked)
        self.kinds = np.unique(np.concatenate([*ranked.values(), np.zeros(0, np.uint32)])).astype(np.uint32)
        self.place = np.full((len(self.langs), len(self.kinds) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.place[i, np.searchsorted(self.kinds, ranked[lang])] = np.arange(len(ranked[lang]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Of a text's profile to each language, as a share of the largest possible one."""
        at = np.searchsorted(self.kinds, own)
        at[(at == len(self.kinds)) | (self.kinds[np.minimum(at, len(self.kinds) - 1)] != own)] = len(self.kinds)
        place = self.place[:, at]
        away = np.where(place < 0, self.length, np.minimum(np.abs(place - np.arange(len(own))), self.length))
        return away.sum(axis=1) / (self.length * len(own))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (1 less the distance), and how much nearer it is than the second, as a share of the second."""
        own = profile(*counted(text), self.length) if text else []
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0, 0.0
        far = self.distances(own)
        best = int(np.argmin(far))
        rest = np.delete(far, best).min() if len(far) > 1 else 1.0
        return self.langs[best], float(1 - far[best]), float((rest - far[best]) / rest) if rest else 0.0


def learn(docs: DataFrame, most_train: int = MOST_TRAIN, length: int = LENGTH) -> Profiles:
    """Profiles from the labelled ``docs(text, lang)``, at most ``most_train`` rows of them.

    Executors sum n-grams by language; what comes to the driver are the
    profiles' candidates, bounded by the number of languages times ``length``.
    """
    from pyspark.sql import Window

    rows = docs.where("lang is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    bound = rows.select("h").orderBy("h").limit(most_train).agg(F.max("h")).first()[0]
    if bound is None:
        return Profiles({}, length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kinds, counts = counted(text)
                own = sums.setdefault(lang, [])
                own.append((kinds, counts))
                if sum(len(k) for k, _ in own) > 2_000_000:
                    sums[lang] = [added(own)]
        for lang, own in sums.items():
            kinds, counts = added(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds)), pa.array(kinds.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "kind", "n"])

    summed = rows.where((F.col("h") <= bound) & F.col("text").isNotNull()).select("lang", "text").mapInArrow(count, "lang string, kind long, n long").groupBy("lang", "kind").agg(F.sum("n").alias("n"))
    top = summed.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "kind"))).where(F.col("place") <= length)
    ranked: dict[str, list] = {}
    for row in sorted(top.collect(), key=lambda r: r.place):
        ranked.setdefault(row.lang, []).append(row.kind)
    return Profiles({k: np.array(v, np.uint32) for k, v in ranked.items()}, length)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``margin``; what ``docs`` has of these names is replaced."""
    def run(texts: pa.Array) -> pa.Array:
        got = [profiles.predict(t.as_py()) for t in texts]
        cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
        return pa.StructArray.from_arrays(cols, names=["lang_pred", "score", "margin"])

    found = F.arrow_udf(run, "lang_pred string, score double, margin double")
    kept = docs.select(*(c for c in docs.columns if c not in ("lang_pred", "score", "margin", "_found")))
    return kept.withColumn("_found", found(F.col("text").cast("string"))).select(*kept.columns, "_found.*")
