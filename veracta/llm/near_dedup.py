"""Near-duplicate documents by probability Jaccard (ProbMinHash signatures, banding, exact verification).

A document is the weighted set of its shingles of five words; a shingle's
weight is how often it occurs. Each shingle emits a Poisson process whose rate
is its weight; every arrival falls on one register at random and a register
keeps its earliest arrival's shingle. Two registers agree with the probability
Jaccard of the two sets. Arrivals later than the latest register change
nothing, so a shingle stops early.

Exact copies share one representative first. Its signature is cut into bands
(with repeated shingles, that of the bare set too, for plain Jaccard), and
each band's bucket gets a leader, the member that meets most others. First
every member is compared with its leaders, which costs one row for each of
them. Texts that share a bucket share its leader, so what may still be linked
are a leader's members that did not come into one class. They are dealt out in
blocks of bounded size: those outside the leader's largest class meet all
members of other classes, a pair of blocks at a time and by exact similarity.
A pair of blocks gives the links that join classes and no others, so a group
of any size never stands as its pairs, nor in one task.

A pair counts as a link if its plain or its probability Jaccard is high enough.
Shingles are kept for texts that share a bucket only, and are taken from their
texts once those are known.

Nulls and edge cases: a text that is null or has no word is in a class of its
own. A text of one to four words is one shingle. Rows with a
null ``doc_id`` are returned with a null class. Repeated rows stay repeated.
Different texts with one ``doc_id`` are in one class.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .dealing import across_blocks
from .graph import components
from .storage import forget, materialise, only

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
#: What one side of a pair of blocks holds on average, at most: texts, and shingles of theirs.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 19
_WIDTH = 1024
_U53 = 1.0 / (1 << 53)


def shingles(texts: tb.Texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as (text, hash, weight), then for each text two hashes of its sequence of words."""
    spans = tb.words(texts)
    hashed = tb.hashes(texts, spans)
    found, at = tb.ngrams(hashed, spans.doc, n)
    doc = spans.doc[at]
    count = np.bincount(spans.doc, minlength=len(texts))
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    order = (np.arange(len(hashed)) - first[spans.doc]).astype(np.uint64)
    whole = []
    for seed in (0x1234567, 0x89ABCDE):
        total = np.zeros(len(hashed) + 1, np.uint64)
        np.cumsum(tb.mix(hashed ^ tb.mix(order * np.uint64(2) + np.uint64(seed))), out=total[1:])
        whole.append(total[first[1:]] - total[first[:-1]])
    short = np.flatnonzero((count > 0) & (count < n))
    doc, found = np.concatenate([doc, short]), np.concatenate([found, tb.mix(whole[0][short])])
    by = np.lexsort((found, doc))
    doc, found = doc[by], found[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    at = np.flatnonzero(new)
    return doc[at], found[at], np.diff(np.append(at, len(doc))), whole[0], whole[1]


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash registers of ``n`` weighted sets, each register with its earliest element; 0 for an empty set."""
    best = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint64)
    live, time, turn = np.arange(len(doc)), np.zeros(len(doc)), 0
    while len(live):
        turn += 1
        draw = tb.mix(element[live] + np.uint64(turn * 0xD1342543DE82EF95 % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * _U53) / weight[live]
        place = doc[live] * registers + (tb.mix(draw ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, place, time)
        won = time == best[place]
        kept[place[won]] = element[live[won]]
        latest = best.reshape(n, registers).max(axis=1)
        more = time < latest[doc[live]]
        live, time = live[more], time[more]
    return kept.reshape(n, registers)


def _banded(sig: np.ndarray) -> np.ndarray:
    """One hash for each band of signatures cut into bands; equal registers in different bands give different ones."""
    band = np.broadcast_to(tb.mix(np.arange(1, sig.shape[1] + 1, dtype=np.uint64)), sig.shape[:2])
    for j in range(sig.shape[2]):
        band = tb.mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, j] + np.uint64(j))
    return band


def _describe(n_words: int, bands: int, rows: int):
    """``doc_id``, two hashes of the sequence of words, the set's size, whether it has repeats, and its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in tb.slices(batch.column(1)):
                doc, found, weight, one, two = shingles(texts, n_words)
                n = hi - lo
                buckets = np.zeros((n, 2, bands), np.uint64)
                buckets[:, 0] = _banded(signatures(doc, found, weight, n, bands * rows).reshape(-1, bands, rows))
                # a text with repeated shingles also has the bands of its bare set, in the same tables
                again = np.zeros(n, bool)
                again[doc[weight > 1]] = True
                own, rank = again[doc], np.cumsum(again) - 1
                bare = signatures(rank[doc[own]], found[own], np.ones(own.sum()), int(again.sum()), bands * rows)
                buckets[again, 1] = _banded(bare.reshape(-1, bands, rows))
                filled = np.ones((n, 2, bands), bool)
                filled[:, 1] = again[:, None] & (buckets[:, 0] != buckets[:, 1])
                ends = np.append(0, np.cumsum(filled.sum(axis=(1, 2)))).astype(np.int32)
                cols = [
                    batch.column(0).slice(lo, n),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.array(np.bincount(doc, minlength=n)),
                    pa.array(again),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets[filled].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k1", "k2", "n", "heavy", "buckets"])

    return run


def _sets(n_words: int):
    """Each text's shingles, sorted, as 32 bits of their hash, with how often they occur (empty: once each). A task
    gives a repeated row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = set()
        for batch in batches:
            for lo, hi, texts in tb.slices(batch.column(1)):
                doc, found, weight, one, two = shingles(texts, n_words)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                short = (found >> np.uint64(32)).astype("<u4")  # found is in order, so this is too
                out = []
                for rep, x, y, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), one.view(np.int64).tolist(), two.view(np.int64).tolist(), first[:-1], first[1:], strict=True):
                    if a == b or (rep, x, y) in given:
                        continue
                    given.add((rep, x, y))
                    at = np.flatnonzero(np.append(True, short[a + 1 : b] != short[a : b - 1]))
                    own = np.add.reduceat(weight[a:b], at)  # two shingles in some billions share 32 bits
                    out.append((rep, x, y, short[a:b][at].tobytes(), own.astype("<u4").tobytes() if (own > 1).any() else b""))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=["rep", "k1", "k2", "members", "weights"])

    return run


def similarity(a: np.ndarray, x: np.ndarray | None, b: np.ndarray, y: np.ndarray | None) -> tuple[float, float]:
    """Jaccard, and probability Jaccard under the weights ``x`` and ``y`` (None: all 1), of two sorted sets."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    union = len(a) + len(b) - len(both)
    if not union:
        return 0.0, 0.0
    plain = len(both) / union
    if x is None and y is None or not len(both):
        return plain, plain
    x, y = (np.ones(len(a)) if x is None else x.astype(float)), (np.ones(len(b)) if y is None else y.astype(float))
    x, y, x_only, y_only = x[i], y[j], x.sum() - x[i].sum(), y.sum() - y[j].sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    low = np.cumsum(x)  # sum of x where y_j / x_j is at most this ratio
    high = y.sum() - np.cumsum(y)
    return plain, float((1 / ((x_only + low) / x + (y_only + high) / y)).sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, lw, right, rw = (batch.column(k) for k in ("am", "aw", "bm", "bw"))
        out = []
        for k in range(batch.num_rows):
            a, x, b, y = (np.frombuffer(c[k].as_buffer(), "<u4") for c in (left, lw, right, rw))
            out.append(max(similarity(a, x if len(x) else None, b, y if len(y) else None)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs that are similar enough."""
    for side in "ab":
        own = sets.select(F.col("rep").alias(side), F.col("members").alias(f"{side}m"), F.col("weights").alias(f"{side}w"))
        pairs = pairs.join(own, side)
    cols = ["a", "b", "am", "aw", "bm", "bw"]
    return pairs.select(*cols).mapInArrow(_verify, "a long, b long, similarity double").where(F.col("similarity") >= threshold).select("a", "b").distinct()


def shares(a: np.ndarray, x: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Probability Jaccard of one weighted set with each of several others."""
    row, token, weight = np.repeat(np.arange(len(others)), [len(b) for b, _ in others]), *(np.concatenate(c) for c in zip(*others, strict=True))
    at = np.minimum(np.searchsorted(a, token), len(a) - 1)
    hit = a[at] == token
    y = np.zeros((len(others), len(a)))
    y[row[hit], at[hit]] = weight[hit]
    mine = np.where(y > 0, x, 0.0)
    order = np.argsort(np.where(y > 0, y / x, np.inf), axis=1, kind="stable")
    mine, y = np.take_along_axis(mine, order, 1), np.take_along_axis(y, order, 1)
    low = x.sum() - mine.sum(axis=1, keepdims=True) + np.cumsum(mine, axis=1)
    high = np.bincount(row, weight, len(others))[:, None] - np.cumsum(y, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(y > 0, 1 / (low / mine + high / y), 0.0).sum(axis=1)


def _overlaps(sets: list[np.ndarray], weights: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``left`` with each of ``right``: common shingles, and the sum of the roots of their shares' products."""
    who, token = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    root = np.concatenate([np.sqrt(w / w.sum()) for w in weights]).astype(np.float32)
    kinds, at, often = np.unique(token, return_inverse=True, return_counts=True)
    shared = often[at] > 1  # a shingle of one text only is common to no pair
    who, root, col = who[shared], root[shared], (np.cumsum(often > 1) - 1)[at[shared]]
    order = np.argsort(col, kind="stable")
    who, root, col = who[order], root[order], col[order]
    common, alike = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
    weighted = any((w > 1).any() for w in weights)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, _WIDTH):
        i, j = np.searchsorted(col, [lo, lo + _WIDTH])
        for out, value in ((common, np.float32(1)), (alike, root[i:j]))[: 1 + weighted]:
            dense = np.zeros((len(sets), _WIDTH), np.float32)
            dense[who[i:j], col[i:j] - lo] = value
            out += dense[left] @ dense[right].T
    return common, alike


def joining(reps: np.ndarray, classes: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], weights: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links between ``left`` and ``right`` that join all classes that any similar pair of theirs joins.

    Probability Jaccard is at most what the two sets' shares have in common, and that at most the sum of the roots of
    the shares' products; pairs with repeated shingles are computed where that sum reaches the threshold.
    """
    common, alike = _overlaps(sets, weights, left, right)
    size = np.array([len(s) for s in sets])
    heavy = np.array([(w > 1).any() for w in weights])
    plain = common.astype(float) / (size[left][:, None] + size[right][None, :] - common)
    kinds, parent = np.unique(classes, return_inverse=True)
    label = np.arange(len(kinds))  # of each class, the least one that it has been joined to
    out: list[tuple[int, int]] = []

    def join(i: np.ndarray, j: np.ndarray) -> None:
        pair = parent[left[i]] * len(kinds) + parent[right[j]]
        for k in np.unique(pair, return_index=True)[1]:
            a, b = label[parent[left[i[k]]]], label[parent[right[j[k]]]]
            if a != b:
                out.append((int(reps[left[i[k]]]), int(reps[right[j[k]]])))
                label[label == max(a, b)] = min(a, b)

    join(*np.nonzero((plain >= threshold) & (classes[left][:, None] != classes[right][None, :])))
    for i in np.flatnonzero(heavy[left] | heavy[right].any()):
        a = left[i]
        j = np.flatnonzero((heavy[a] | heavy[right]) & (alike[i] >= threshold - 1e-3) & (label[parent[right]] != label[parent[a]]))
        step = max(1, (1 << 17) // len(sets[a]))
        for lo in range(0, len(j), step):
            some = j[lo : lo + step]
            near = some[shares(sets[a], weights[a], [(sets[k], weights[k]) for k in right[some]]) >= threshold]
            join(np.full(len(near), i), near)
    return out


def _joined(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        reps, classes, side = (table.column(c).to_numpy() for c in ("rep", "class", "side"))
        sets = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("members")]
        weights = [np.frombuffer(x.as_buffer(), "<u4").astype(float) for x in table.column("weights")]
        weights = [w if len(w) else np.ones(len(s)) for s, w in zip(sets, weights, strict=True)]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if table.column("own")[0].as_py():
            right = left
        found = joining(reps, classes, left, right, sets, weights, threshold) if len(left) and len(right) else []
        return pa.table([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n_words: int = WORDS, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK_TEXTS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``class_id`` (least doc_id of its class), ``n_copies`` (rows
    with the same words)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, k1 long, k2 long, n long, heavy boolean, buckets array<long>"
    described = materialise(texts.mapInArrow(_describe(n_words, bands, rows), kinds), "described")
    filled = described.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # one row for each distinct text
    own = F.min_by(F.struct("n", "heavy", "buckets"), "doc_id").alias("own")
    copies = materialise(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), own).select("k1", "k2", "rep", "n_copies", "own.*"), "copies")

    placed = copies.select("rep", "n", "heavy", F.explode("buckets").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = materialise(placed.join(sizes, "bucket"), "buckets")
    central = met.groupBy("rep").agg(F.sum("size").alias("meets"))
    leaders = met.join(central, "rep").groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("rep")).alias("rep"), "n", "heavy")).alias("lead"))
    seats = met.join(leaders, "bucket").select((-F.col("lead.rep")).alias("leader"), F.col("lead.n").alias("ln"), F.col("lead.heavy").alias("lheavy"), "rep", "n", "heavy")
    seats = materialise(seats.where("rep <> leader").distinct(), "seats")
    wanted = seats.select("rep").union(seats.select("leader")).distinct()
    found = only(texts.withColumnRenamed("doc_id", "rep"), wanted, "rep").mapInArrow(_sets(n_words), "rep long, k1 long, k2 long, members binary, weights binary")
    sets = materialise(found.dropDuplicates(["rep", "k1", "k2"]).select("rep", "members", "weights"), "sets")

    # sets with repeated shingles can be similar whatever their sizes
    likely = F.col("heavy") | F.col("lheavy") | (F.least("n", "ln") >= F.lit(threshold) * F.greatest("n", "ln"))
    tried = seats.where(likely).select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    links = materialise(_links(tried, sets, threshold), "links")
    classes = components(links)
    known = seats.select("leader", "rep", "n").join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    members = materialise(known, "members")
    some, links = links, materialise(links.unionByName(across_blocks(members, sets, _joined(threshold), block, BLOCK_SHINGLES)), "all-links")
    classes = components(links)
    for table in (met, seats, sets, members, some, links):
        forget(table)  # what is returned reads texts' keys, copies and classes only

    member = copies.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("class", "rep").alias("class"), "n_copies")
    # every row finds its text's class; a text that a third of the rows share is a skewed join, which Spark can split
    every = described.select("doc_id", "k1", "k2", "n").join(member, ["k1", "k2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0) | F.col("class").isNull()
    return every.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` of which one document of each class stays: the one with the least ``doc_id``.

    Rows repeated with the same id keep one of them. Rows with a null id stay.
    """
    keep = near_duplicates(docs, **options).where("class_id = doc_id").select("doc_id").distinct()
    one = docs.where(F.col("doc_id").isNotNull()).join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
