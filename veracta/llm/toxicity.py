"""Toxicity by a counterfactual-regularised classifier.

A text is the set of its words and of longer words' first bytes (hashed; ASCII
letters lower-cased). A logistic
regression is fitted on labelled texts over the words that tell the two labels
apart. Its loss has one more term: in each training text, identity terms are
swapped for every other of their group, and for none, and a change of the
score (its log odds) is penalised, so
that a neutral mention of a group isn't taken for abuse. A term is swapped with
all that it gives, its word and its first bytes. What the identity
groups give is always among the features, so that the penalty has something to
hold.

At most ``most_train`` labelled rows are read for learning, those with the
least hash of their id; every text is scored whole. A null or empty text has
the score of no words. If one of the labels is missing, every score is the
label's share (0 without labels). Repeated rows stay; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

MOST_TRAIN, FEATURES, CUT, PREFIXES = 8_000, 2_000, 0.7, (6, 8)
PENALTY, RIDGE, STEPS = 4.0, 1e-4, 600

#: Groups of identity terms; each is swapped for the next of its group. Fixed values.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus"),
    ("immigrants", "natives"), ("disabled", "abled"), ("old", "young"), ("african", "european", "american"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

_WORD = np.zeros(256, bool)
_WORD[list(range(ord("a"), ord("z") + 1)) + list(range(ord("A"), ord("Z") + 1)) + list(range(128, 256))] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_TABLE = tb._BYTES[_LOWER]


def features(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and prefixes of each text: (text, hash), in order. Hashes are cut to 40 bits, so that both fit one number."""
    spans = tb.runs(_WORD[texts.data], texts)
    found = [(spans.doc, tb.hashes(texts, spans, _TABLE))]
    for n in PREFIXES:
        long = spans.end - spans.start > n
        cut = tb.Spans(spans.start[long], spans.start[long] + n, spans.doc[long])
        found.append((cut.doc, tb.mix(tb.hashes(texts, cut, _TABLE) + np.uint64(n))))
    doc, hashed = (np.concatenate(x) for x in zip(*found, strict=True))
    both = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (hashed >> np.uint64(24)))
    return (both >> np.uint64(40)).astype(np.int64), (both & np.uint64((1 << 40) - 1)).astype(np.int64)


def terms(groups=IDENTITIES) -> list[list[list[int]]]:
    """For each group and term the term's features, its word first."""

    def given(word: str) -> list[int]:
        _, _, texts = next(tb.slices(pa.array([word])))
        whole = int((tb.hashes(texts, tb.runs(_WORD[texts.data], texts), _TABLE) >> np.uint64(24))[0])
        return [whole, *(k for k in features(texts)[1].tolist() if k != whole)]

    return [[given(w) for w in group] for group in groups]


def counterfactuals(own: set[int], known: list[list[list[int]]]) -> list[set[int]]:
    """A text's features with its identity terms swapped for the next of their group, the one after, and so on, and dropped."""
    present = [(group, i) for group in known for i, t in enumerate(group) if t[0] in own]
    if not present:
        return []
    rest = own - {k for group, i in present for k in group[i]}
    turns = range(1, max(len(group) for group, _ in present))
    return [rest | {k for group, i in present for k in group[(i + r) % len(group)]} for r in turns] + [rest]


class Model:
    """Weights by word hash."""

    def __init__(self, kinds: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(kinds)
        self.kinds, self.weights, self.bias = kinds[order], weights[order], bias

    def scores(self, texts: tb.Texts) -> np.ndarray:
        doc, found = features(texts)
        z = np.full(len(texts), self.bias)
        if len(self.kinds):
            at = np.minimum(np.searchsorted(self.kinds, found), len(self.kinds) - 1)
            hit = self.kinds[at] == found
            np.add.at(z, doc[hit], self.weights[at[hit]])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(sets: list[np.ndarray], labels: np.ndarray, groups=IDENTITIES, penalty: float = PENALTY, most: int = FEATURES) -> Model:
    """A model from each text's word hashes and its label."""
    n, positive = len(sets), int(labels.sum())
    if not n or positive in (0, n):
        share = positive / n if n else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-12) / (1 - share + 1e-12))))
    doc, found = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    kinds, at = np.unique(found, return_inverse=True)
    on, all_ = tb.totals(labels[doc], at, len(kinds)), np.bincount(at, minlength=len(kinds))
    # how far a word's share of toxic texts is from the others' share, in standard errors
    p, q = on / positive, (all_ - on) / (n - positive)
    mean = all_ / n
    z = np.abs(p - q) / np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / positive + 1 / (n - positive)))
    # among so many words, some are this far apart by chance
    z[(all_ < 3) | (z < np.sqrt(2 * np.log(len(kinds))) + 0.5)] = 0
    known = terms(groups)
    held = np.unique(np.array([k for group in known for t in group for k in t], np.int64))
    chosen = np.unique(np.concatenate([kinds[np.argsort(-z, kind="stable")[:most]][: int((z > 0).sum())], held]))
    place = {int(k): i for i, k in enumerate(chosen)}

    def matrix(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)

    own = [[place[k] for k in s.tolist() if k in place] for s in sets]
    row, col = matrix(own)
    pairs = [(x, [place[k] for k in other if k in place]) for x, s in zip(own, sets, strict=True) for other in counterfactuals(set(s.tolist()), known)]
    a_row, a_col = matrix([x for x, _ in pairs])
    b_row, b_col = matrix([x for _, x in pairs])

    target, weight = labels.astype(float), np.where(labels == 1, 0.5 / positive, 0.5 / (n - positive))
    w, bias = np.zeros(len(chosen)), 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        score = 1 / (1 + np.exp(-(np.bincount(row, w[col], n) + bias)))
        slip = weight * (score - target)
        grad = np.bincount(col, slip[row], len(chosen)) + RIDGE * w
        if pairs:
            gap = 2 * penalty * (np.bincount(a_row, w[a_col], len(pairs)) - np.bincount(b_row, w[b_col], len(pairs))) / len(pairs)
            grad += np.bincount(a_col, gap[a_row], len(chosen)) - np.bincount(b_col, gap[b_row], len(chosen))
        whole = np.append(grad, slip.sum())
        m, v = 0.9 * m + 0.1 * whole, 0.999 * v + 0.001 * whole**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(chosen, w, float(bias))


def learn(docs: DataFrame, most_train: int = MOST_TRAIN, **options) -> Model:
    """A model from labelled ``docs(doc_id, text, toxic)``: at most ``most_train`` rows, whose word hashes come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in tb.slices(batch.column(1)):
                doc, found = features(texts)
                first = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                cols = [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([found[a:b].astype("<i8").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "toxic", "found"])

    rows = docs.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"))
    got = rows.mapInArrow(run, "doc_id long, toxic int, found binary").toArrow().sort_by("doc_id") if most_train else None
    if got is None or not got.num_rows:
        return fit([], np.zeros(0, int), **options)
    return fit([np.frombuffer(x.as_buffer(), "<i8") for x in got.column("found")], got.column("toxic").to_numpy(), **options)


def sample(labels: DataFrame, most: int = MOST_TRAIN) -> DataFrame:
    """``doc_id, toxic`` of at most ``most`` labelled rows, one for each id, by the least hash of the id."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def scored(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; what it has of these names is replaced."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.scores(texts) for _, _, texts in tb.slices(column)] or [np.zeros(0)]))

    kept = docs.select(*(c for c in docs.columns if c not in ("score", "predicted")))
    found = kept.withColumn("score", F.arrow_udf(run, "double")(F.col("text").cast("string")))
    return found.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
