import random
from collections import Counter

import numpy as np
import pytest

from veracta.llm import near_dedup as nd
from veracta.llm.dealing import across_blocks
from veracta.llm.graph import components

from .cases import none, odd


def shingle_set(text, n=5):
    w = (text or "").split()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def weighted(x, y):
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys())
    return total


def brute(docs):
    """Classes and links by every pair of different texts."""
    sets = {i: shingle_set(t) for i, t in docs}
    words = {i: tuple((t or "").split()) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    reps = {}
    for i, _ in sorted(docs):
        if words[i]:
            parent[i] = reps.setdefault(words[i], i)
    own = sorted(reps.values())
    for a in own:
        for b in own:
            if a < b and sets[a] and sets[b]:
                x, y = sets[a], sets[b]
                if max(len(x.keys() & y.keys()) / len(x.keys() | y.keys()), weighted(x, y)) >= 0.8:
                    links[a] += 1
                    links[b] += 1
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (root(i), links[reps[words[i]]] if words[i] else 0) for i, _ in docs}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        docs.append((n, " ".join(base)))
        n += 1
        for _ in range(rng.randint(0, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((n, " ".join(copy)))
            n += 1
    passage = " ".join(rng.choice(words) for _ in range(60))
    for _ in range(30):  # a shared passage is no near copy
        docs.append((n, " ".join(rng.choice(words) for _ in range(90)) + " " + passage))
        n += 1
    line = "a b c d e f g"
    docs += [(n, f"{line} " * 6), (n + 1, f"{line} " * 7), (n + 2, "short one"), (n + 3, "short  one"), (n + 4, ""), (n + 5, None)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("block", [nd.BLOCK_TEXTS, 2])
def test_classes_are_those_of_all_pairs(spark, block):
    docs = corpus()
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()
    want = brute(docs)
    assert len(got) == len(docs)
    assert {r.doc_id: r.class_id for r in got} == {i: c for i, (c, _) in want.items()}
    if block == 2:
        return
    kept = nd.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {c for c, _ in want.values()}


def groups(n, seed=4):
    """Sets of which many share most shingles, some of them heavy, and pairs near by weight only."""
    rng = np.random.default_rng(seed)
    shared, sets = np.arange(1, 41), []
    for k in range(n):
        own = np.arange(1000 * (k + 1), 1000 * (k + 1) + rng.integers(5, 40))
        some = shared if k % 3 else shared[:20]
        heavy = np.concatenate([np.full(len(some), 1 if k % 5 == 0 else 10) + rng.integers(0, 2, len(some)) * (k % 2), np.ones(len(own), int)])
        sets.append((np.concatenate([some, own]), heavy))
    top = 1000 * (n + 9)
    sets += [(np.concatenate([shared[:20], np.arange(a, a + 20)]), np.repeat([10, 1], 20)) for a in (top, top + 1000)]  # plain 0.33, probability Jaccard 0.83
    sets += [(np.append([5], np.arange(a, a + 3)), np.array([200, 1, 1, 1])) for a in (top + 2000, top + 3000)]  # plain 0.14, probability Jaccard 0.97
    return [(m.astype(np.uint32), w.astype(float)) for m, w in sets]


def test_blocks_join_what_any_similar_pair_joins(spark):
    sets = groups(300)
    links, by_weight = [], 0
    for a, (m, x) in enumerate(sets):
        for b in range(a):
            plain, share = nd.similarity(sets[b][0], sets[b][1], m, x)
            assert share == pytest.approx(nd.shares(m, x, [sets[b]])[0])
            if max(plain, share) >= 0.8:
                links.append((b, a))
                by_weight += plain < 0.8
    assert (300, 301) in links and (302, 303) in links and by_weight > 300

    def classes(found):
        parent = list(range(len(sets)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in found:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(i) for i in range(len(sets))]

    everyone, members, weights = np.arange(len(sets)), [m for m, _ in sets], [w for _, w in sets]
    got = nd.joining(everyone, everyone, everyone, everyone, members, weights, 0.8)
    assert classes(got) == classes(links) and len(got) < len(sets) < len(links)

    rows = [(k, bytearray(m.astype("<u4").tobytes()), bytearray(w.astype("<u4").tobytes() if (w > 1).any() else b"")) for k, (m, w) in enumerate(sets)]
    table = spark.createDataFrame(rows, "rep long, members binary, weights binary")
    whole = classes(links)
    big = max(set(whole), key=whole.count)
    for start in (list(range(len(sets))), [big if c == big and k % 4 else k for k, c in enumerate(whole)]):  # nothing known; three quarters of a class known
        seats = spark.createDataFrame([(10**6, k, start[k], len(sets[k][0])) for k in range(len(sets))], "leader long, rep long, class long, n long")
        found = [(r.a, r.b) for r in across_blocks(seats, table, nd._joined(0.8), 32, 1 << 19).collect()]
        assert classes(found + [(k, c) for k, c in enumerate(start) if c != k]) == whole


def test_a_line_repeated_in_one_copy_only(spark):
    rng = random.Random(8)
    docs = []
    for k in range(20):
        base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + base[-10:] * 60))]  # plain 0.97, probability Jaccard far below
    a, b = shingle_set(docs[0][1]), shingle_set(docs[1][1])
    assert len(a.keys() & b.keys()) / len(a.keys() | b.keys()) > 0.95 and weighted(a, b) < 0.3
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i // 2 * 2 for i, _ in docs}


def test_odd_rows(spark):
    got = Counter((r.doc_id, r.class_id, r.n_copies) for r in nd.near_duplicates(odd(spark)).collect())
    assert got[(1, 1, 1)] == got[(2, 2, 1)] == got[(3, 3, 1)] == 1  # texts without words are alone
    assert got[(4, 4, 2)] == got[(5, 4, 2)] == got[(7, 6, 2)] == 1 and got[(9, 9, 2)] == 2 and got[(None, None, 1)] == 1
    assert sum(got.values()) == 13
    assert nd.near_duplicates(none(spark)).collect() == []
    kept = nd.deduplicate(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 8, 9, 10, 11, None]))


def test_registers_agree_with_the_probability_jaccard():
    rng = np.random.default_rng(5)
    a, b = rng.integers(1, 1 << 60, (2, 40), dtype=np.uint64)
    b[:25] = a[:25]
    wa, wb = rng.integers(1, 5, 40), rng.integers(1, 5, 40)
    sig = nd.signatures(np.repeat([0, 1], 40), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4000)
    want = weighted(Counter(dict(zip(a.tolist(), wa.tolist(), strict=True))), Counter(dict(zip(b.tolist(), wb.tolist(), strict=True))))
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.04)
    x, y = np.argsort(a), np.argsort(b)
    assert nd.similarity(a[x], wa[x], b[y], wb[y])[1] == pytest.approx(want)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(5, 4), (4, 3), (7, 7), (50, 60), (60, 50)], "a long, b long")
    got = {r.node: r["class"] for r in components(edges).collect()}
    assert {got[i] for i in range(10, 41)} == {10} and got[5] == 3 and got[60] == 50 and 7 not in got
    assert components(edges.where("a < 0")).collect() == []
