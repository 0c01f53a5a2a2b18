"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give the base spans. Other tokens that look alike are candidates:
numbers of seven digits or more, words with an @, and long words of letters and
digits, which may be secrets (a kind of its own, which has no base spans; one is
plain where a key's or password's name and a sign of assignment stand before it). They and the base spans
are the nodes of a graph. Neighbours in the text are linked, and so are distant
nodes that are equal or alike (same digits, same last digits, same local part);
a key's occurrences are linked one to the next and to the first, so that links
grow with the nodes. Base spans are observed; loopy sum-product messages give
the other nodes' labels, so that an entity that is plain at one place is found
where it is written without what made it plain.

The weights are learned by pseudo-likelihood, with the base spans' kinds as
labels and plain secrets as theirs, on at most ``MOST_NODES`` nodes of some ``most_train`` texts (those with the least hash of
id and text); each node is seen once as it is and once with its telling features
hidden, so that the links have to explain it. A prior draws linked nodes
together where the sample has no links.

A null or empty text has no spans, and the digest of no bytes. Repeated rows
stay, extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds with base spans stand first.
BASE, SECRET = 4, 4
MOST_TRAIN, MOST_NODES, NEAR, ROUNDS, CERTAIN = 4_000, 20_000, 60, 12, 0.5

# The patterns' own starts keep the search linear; they match what the contract's patterns match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+")
_AT = re.compile(r"[^\s@<>,;()\"']{1,256}@[^\s@<>,;()\"']{1,256}")
_WORD = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,128}(?![A-Za-z0-9_-])")
_NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|auth\w*)[\"']?\s*(?:[:=]|is)?\s*[\"']?$", re.I)
_DIGITS = re.compile(r"[0-9]")
_HINTS = (re.compile(r"e-?mail|mailto", re.I), re.compile(r"\bip\b|host|server", re.I), re.compile(r"card|visa|credit|iban", re.I), re.compile(r"tel|phone|call|fax|mobil", re.I))


def luhn(digits: str) -> bool:
    own = np.frombuffer(digits.encode(), np.uint8)[::-1].astype(np.int64) - 48
    own[1::2] *= 2
    return int(np.where(own > 9, own - 9, own).sum()) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and _LOCAL.match(text, lo - 1):
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            yield lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the four patterns find, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


FEATURES = 27
#: Features that make a kind plain by themselves, hidden in the second view of a training node.
TELLING = [2, 3, 4, 5, 6, 25]


def node_features(text: str, start: int, end: int) -> np.ndarray:
    own = text[start:end]
    before = text[max(0, start - 24) : start]
    x = np.zeros(FEATURES)
    x[0] = 1
    x[23] = before.rstrip()[-1:] in ("=", '"', "#")
    if _WORD.fullmatch(own):
        x[24], x[25], x[26] = 1, _NAMED.search(before) is not None, re.fullmatch("[0-9a-fA-F]+", own) is not None
        return x
    digits = re.sub("[^0-9]", "", own)
    n, at = len(digits), "@" in own
    x[1] = at
    x[2] = at and _DOMAIN.search(own, own.index("@") + 1) is not None
    x[3] = not at and own.count(".") == 3 and _IP.fullmatch(own) is not None
    x[4] = not at and 14 <= n <= 19 and luhn(digits)
    x[5] = not at and own[0] == "+" and 10 <= n <= 15
    x[6] = not at and "(" in own
    for i, (lo, hi) in enumerate(((0, 6), (7, 9), (10, 10), (11, 12), (13, 13), (14, 19), (20, 1 << 60))):
        x[7 + i] = not at and lo <= n <= hi
    x[14] = " " in own
    x[15] = "-" in own
    x[16] = not at and "." in own
    for i, hint in enumerate(_HINTS):
        x[17 + i] = hint.search(before) is not None
    x[21] = start > 0 and text[start - 1].isalnum()
    x[22] = end < len(text) and text[end].isalnum()
    return x


def _keys(own: str) -> list[str]:
    if "@" in own:
        local = own.partition("@")[0].lower()
        return [f"m{own.lower()}", f"l{local}"]
    if _WORD.fullmatch(own):
        return [f"s{own.lower()}"]
    digits = re.sub("[^0-9]", "", own)
    if own.count(".") == 3:
        return [f"i{own}"]
    return [f"d{digits}", f"e{digits[-9:]}"] if len(digits) >= 7 else [f"d{digits}"]


def graph(text: str) -> tuple[list[tuple[int, int]], np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """Nodes as spans in order, their observed labels (0: none), links of neighbours, skip links."""
    base = base_spans(text)
    nodes = {(a, b): k + 1 for a, k, b in reversed(base)}
    ends, reach = [], 0
    for a, _, b in base:
        reach = max(reach, b)
        ends.append((a, reach))
    starts = [a for a, _ in ends]
    found = [m.span() for m in _WORD.finditer(text)]
    within = [a for a, _ in found]

    def apart(a: int, b: int) -> bool:  # a number inside a long word is no node of its own
        i = int(np.searchsorted(within, b)) - 1
        return i < 0 or found[i][1] <= a

    numbers = [m.span() for m in _NUMBER.finditer(text)] + ([m.span() for m in _AT.finditer(text)] if "@" in text else [])
    found = found + [s for s in numbers if apart(*s)]
    for a, b in sorted(found):
        i = int(np.searchsorted(starts, b)) - 1  # the last base span that begins before b
        if i < 0 or ends[i][1] <= a:
            nodes.setdefault((a, b), 0)
    order = sorted(nodes)
    chain = [(i, i + 1) for i in range(len(order) - 1) if order[i + 1][0] - order[i][1] <= NEAR]
    skip, seen = set(), {}
    for i, (a, b) in enumerate(order):
        for key in _keys(text[a:b]):
            first, last = seen.get(key, (i, i))
            if first != i:
                skip |= {(first, i), (last, i)}
            seen[key] = (first, i)
    return order, np.array([nodes[s] for s in order], np.int64), chain, sorted(skip)


N = len(KINDS) + 1


class Weights:
    """Of the features for each label, and of the labels of linked nodes."""

    def __init__(self, own: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.own, self.chain, self.skip = own, chain, skip


def prior() -> Weights:
    own = np.zeros((FEATURES, N))
    own[0, 0] = 2.0
    for k, (f, w) in enumerate(((2, 4.0), (3, 4.0), (4, 4.0), (5, 4.0), (25, 6.0))):
        own[f, k + 1] = w
    skip = np.zeros((N, N))
    skip[range(N), range(N)] = 4.0  # for no entity too, or else unlabelled repeats would talk each other into one
    return Weights(own, np.zeros((N, N)), skip)


def fit(x: np.ndarray, near: np.ndarray, far: np.ndarray, label: np.ndarray, ridge: float = 0.02, steps: int = 300) -> Weights:
    """By pseudo-likelihood: each node's label from its features and its neighbours' labels (counts)."""
    start = prior()
    mean = np.vstack([start.own, start.chain, start.skip])
    if not len(label):
        return start
    plain = x.copy()
    plain[:, TELLING] = 0
    linked = far.sum(axis=1) > 0
    full = np.hstack([np.vstack([x, plain[linked]]), np.vstack([near, near[linked]]), np.vstack([far, far[linked]])])
    want = np.eye(N)[np.concatenate([label, label[linked]])]
    w, m, v = mean.copy(), np.zeros_like(mean), np.zeros_like(mean)
    for step in range(1, steps + 1):
        z = full @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = full.T @ (p - want) / len(want) + ridge * (w - mean)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    chain, skip = w[FEATURES : FEATURES + N], w[FEATURES + N :]
    return Weights(w[:FEATURES], (chain + chain.T) / 2, (skip + skip.T) / 2)


def marginals(unary: np.ndarray, links: list[tuple[int, int]], tables: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product over log potentials: each node's label probabilities."""
    if links:
        a, b = np.array(links).T
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        pot = np.concatenate([np.array(tables), np.array(tables).transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        sent = np.zeros((len(src), unary.shape[1]))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, dst, sent)
            away = belief[src] - sent[back]
            new = (away[:, :, None] + pot).transpose(0, 2, 1)
            top = new.max(axis=2, keepdims=True)
            new = (top + np.log(np.exp(new - top).sum(axis=2, keepdims=True)))[:, :, 0]
            sent = 0.5 * sent + 0.5 * (new - new.max(axis=1, keepdims=True))
        unary = unary.copy()
        np.add.at(unary, dst, sent)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def spans(text: str, weights: Weights) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each as (start, kind, end)."""
    base = base_spans(text)
    if not _DIGITS.search(text) and "@" not in text:
        return base, base
    nodes, seen, chain, skip = graph(text)
    free = np.flatnonzero(seen == 0)
    if not len(free):
        return base, base
    unary = np.array([node_features(text, a, b) for a, b in nodes]) @ weights.own
    fixed = seen > 0
    unary[fixed] = -1e3
    unary[fixed, seen[fixed]] = 0
    links = chain + skip
    p = marginals(unary, links, [weights.chain] * len(chain) + [weights.skip] * len(skip))
    more = [(nodes[i][0], int(p[i].argmax()) - 1, nodes[i][1]) for i in free if p[i].argmax() > 0 and p[i].max() >= CERTAIN]
    return base, sorted(base + more)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def learn(docs: DataFrame, most_train: int = MOST_TRAIN, most_nodes: int = MOST_NODES) -> Weights:
    """Weights from at most ``most_nodes`` nodes of some ``most_train`` texts of ``docs(doc_id, text)``; those nodes
    come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h, text = (batch.column(c)[row].as_py() for c in (0, 1))
                nodes, seen, chain, skip = graph(text or "")
                x = np.array([node_features(text, *n) for n in nodes[:most_nodes]]).reshape(-1, FEATURES)
                label = seen.copy()
                label[: len(x)][(seen[: len(x)] == 0) & (x[:, 25] > 0)] = SECRET + 1
                near, far = np.zeros((len(nodes), N)), np.zeros((len(nodes), N))
                for out, links in ((near, chain), (far, skip)):
                    for i, j in links:
                        out[i, label[j]] += 1
                        out[j, label[i]] += 1
                rows = np.hstack([label[: len(x), None], x, near[: len(x)], far[: len(x)]])
                cols = [pa.array(np.full(len(x), h, np.int64)), pa.array(np.arange(len(x))), pa.array(list(rows), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "i", "row"])

    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    bound = rows.select("h").orderBy("h").limit(most_train).agg(F.max("h")).first()[0]
    got = []
    if bound is not None:
        nodes = rows.where(F.col("h") <= bound).mapInArrow(run, "h long, i long, row array<double>")
        got = [r.row for r in nodes.orderBy("h", "i").limit(most_nodes).collect()]  # equal rows may share a hash
    got = np.array(sorted(got)).reshape(-1, 1 + FEATURES + 2 * N)
    return fit(got[:, 1 : 1 + FEATURES], got[:, 1 + FEATURES : 1 + FEATURES + N], got[:, 1 + FEATURES + N :], got[:, 0].astype(int))


def _described(texts: pa.Array, weights: Weights) -> pa.Array:
    out = []
    for t in texts:
        base, every = spans(t.as_py() or "", weights)
        counts = [sum(k == i for _, k, _ in base) for i in range(BASE)]
        out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
    kinds = [pa.int64()] * BASE + [pa.string()] * 2
    cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
    return pa.StructArray.from_arrays(cols, names=[*(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans"])


def _redacted(texts: pa.Array, weights: Weights) -> pa.Array:
    out = []
    for t in texts:
        text = t.as_py()
        parts, at = [], 0
        for a, k, b in spans(text or "", weights)[1]:
            if a >= at:
                parts += [text[at:a], f"<{KINDS[k].upper()}>"]
            at = max(at, b)
        out.append("".join([*parts, text[at:]]) if text is not None else None)
    return pa.array(out, pa.string())


def detected(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id``, the base spans' number of each kind and digest, and all spans, for each row of ``docs``."""
    kinds = ", ".join([*(f"n_{k} long" for k in KINDS[:BASE]), "base_sha256 string", "spans string"])

    def run(texts: pa.Array) -> pa.Array:
        return _described(texts, weights)

    found = F.arrow_udf(run, kinds)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("f", found("text")).select("doc_id", "f.*")


def redacted(docs: DataFrame, weights: Weights) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, and ``n_chars`` counted anew if there is one."""

    def run(texts: pa.Array) -> pa.Array:
        return _redacted(texts, weights)

    out = docs.withColumn("text", F.arrow_udf(run, "string")(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
