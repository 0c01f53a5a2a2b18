import hashlib
import itertools
import random
import re

import numpy as np

from veracta.llm import personal_data as P

from .cases import none, odd, odd_rows


def brute(text):
    """The contract's four patterns as they stand."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(6)
    bits = ["a@b.co", "x.y+z@q-1.example.org", "@", "a@", "@b.c", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+33 1 23 45 67 89", "+1 (499) 555-6503", "+12", "12", ".", "-", " ", " ", "w", "é", "5"]
    for _ in range(600):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert P.base_spans(text) == brute(text), text
    assert P.base_spans("9" * 20_000 + "." + "9" * 5000 + ".1.1") == []  # long runs take no long time


def test_a_distant_repeat_is_found_by_its_links_and_base_spans_stay():
    text = "Call +33 1 23 45 67 89 today. " + "filler " * 200 + "or dial 33123456789 then. Order 7654321 stays."
    base, every = P.spans(text, P.prior())
    assert set(base) <= set(every)
    assert [text[a:b] for a, _, b in sorted(set(every) - set(base))] == ["33123456789"]
    alone = "or dial 33123456789 then. Order 7654321 stays."
    assert P.spans(alone, P.prior())[1] == []


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(2)
    unary, links, tables = rng.normal(size=(3, P.N)), [(0, 1), (1, 2)], [rng.normal(size=(P.N, P.N)) for _ in range(2)]
    joint = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + tables[0][:, :, None] + tables[1][None, :, :])
    want = np.stack([joint.sum(ax) for ax in ((1, 2), (0, 2), (0, 1))])
    got = P.marginals(unary, links, tables, rounds=60)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)


def test_secrets_are_found_where_they_are_named_and_where_they_repeat():
    key, other = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", "9f0c1d2e3b4a59687766554433221100ffeeddcc"
    text = f'A token = "{key}" here. ' + "filler " * 200 + f"then {key} and the file {other} stay. Call +33 1 23 45 67 89."
    base, every = P.spans(text, P.prior())
    more = sorted(set(every) - set(base))
    assert [text[a:b] for a, _, b in more] == [key, key] and {k for _, k, _ in more} == {P.SECRET}
    assert P.KINDS[: P.BASE] == ("email", "ip", "card", "phone")


def test_marginals_of_a_text_are_those_of_all_labellings():
    """Loopy messages on a text's own small graph give the labels that summing over all labellings gives."""
    key = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"
    for text in (f"password: {key} xx +33 1 23 45 67 89 yy 33123456789 zz {key}", f"{key} and {key} and 7654321", "a@b.co then a@b then 1.2.3.4 then 1234567"):
        weights = P.prior()
        nodes, seen, chain, skip = P.graph(text)
        unary = np.array([P.node_features(text, *n) for n in nodes]) @ weights.own
        for i in np.flatnonzero(seen):
            unary[i] = -1e3
            unary[i, seen[i]] = 0
        total = np.zeros((len(nodes), P.N))
        for labels in itertools.product(range(P.N), repeat=len(nodes)):
            score = sum(unary[i, k] for i, k in enumerate(labels)) + sum(weights.skip[labels[i], labels[j]] for i, j in skip)
            for i, k in enumerate(labels):
                total[i, k] += np.exp(score)
        got = P.marginals(unary, chain + skip, [weights.chain] * len(chain) + [weights.skip] * len(skip))
        assert (got.argmax(1) == total.argmax(1)).all()


def test_few_nodes_come_to_the_driver(spark):
    text = " ".join(f"{i:09d}" for i in range(3000))
    df = spark.createDataFrame([(None, text)] * 40, "doc_id long, text string")
    weights = P.learn(df, most_train=5, most_nodes=50)
    assert P.detected(df, weights).count() == 40


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        phone = f"+33 1 {rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)}"
        rows.append((i, f"word {phone} text mail{i}@ex.org and {rng.randint(1000000, 9999999)} units " + (f"again {re.sub('[^0-9]', '', phone)} end" if i % 2 else "")))
    return rows


def test_learned_weights_keep_strangers_out(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    weights = P.learn(df)
    got = {r.doc_id: r for r in P.detected(df, weights).collect()}
    for i, text in corpus():
        base = brute(text)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(P.joined(base).encode()).hexdigest()
        assert set(P.joined(base).split(",")) <= set(r.spans.split(","))
        units = re.search(r"\d{7}(?= units)", text)
        assert f"{units.start()}:{units.end()}" not in r.spans
    clean = P.redacted(df, weights).collect()
    assert all("@" not in r.text and "<EMAIL>" in r.text and "<PHONE>" in r.text for r in clean)


def test_odd_rows(spark):
    weights = P.learn(odd(spark))
    got = P.detected(odd(spark), weights).collect()
    assert len(got) == len(odd_rows())
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.base_sha256, r.spans) == (empty, "") for r in got if r.doc_id in (1, 2, 3, 4))
    assert P.detected(none(spark), P.learn(none(spark))).collect() == []
    df = odd(spark).selectExpr("*", "0L as n_chars")
    again = P.redacted(df, weights)
    assert again.columns == df.columns and {r.text for r in again.where("doc_id = 1").collect()} == {None}
