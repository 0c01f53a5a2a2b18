import random

import pytest
from pyspark.sql import functions as F

from veracta.llm import mixing as X

from .cases import none, odd, odd_rows


def water(sizes, weights=X.WEIGHTS, most=X.MOST):
    """The contract's rule, step by step: those above their cap stop there and the excess is shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def corpus(seed=5, n=1500):
    rng = random.Random(seed)
    sources = ["hot"] * 12 + ["b", "Z", "é", "small", "tiny", None, "c"]
    rows = []
    for i in range(n):
        s = rng.choice(sources)
        rows.append((i, "w " * rng.randint(0, 6 if s in ("small", "tiny") else 200), s))
    return rows


def test_targets_taken_and_limits(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in X.mixed(df).collect()}
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for i, text, s in rows:
        assert got[i].size == len(text.split()) and got[i].taken <= 3 * got[i].size
        sizes[s] = sizes.get(s, 0) + got[i].size
        taken[s] = taken.get(s, 0) + got[i].taken
    goal = water(sizes)
    for i, _, s in rows:
        assert got[i].target == pytest.approx(goal[s]) and got[i].source_size == sizes[s]
    for s in sizes:
        # five standard deviations of the draw, and a few blocks
        assert taken[s] == pytest.approx(goal[s], abs=5 * (goal[s] * X.BLOCK) ** 0.5 + 3 * X.BLOCK), s
    again = {r.doc_id: r.taken for r in X.mixed(df.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_each_turn_takes_every_block_once(spark):
    goal = spark.createDataFrame([("a", 128 * 50, 5.0, 128.0 * 140), ("b", 128 * 70 + 5, 1.0, 128.0 * 100)], "source string, source_size long, weight double, target double")
    uses = X.slots(goal, 1, block=128).collect()
    a = {r["index"]: r.uses for r in uses if r.source == "a"}
    b = {r["index"]: r.uses for r in uses if r.source == "b"}
    for one, blocks in ((a, 50), (b, 71)):
        turns = sum(one.values()) // blocks
        assert set(one) <= set(range(blocks)) and set(one.values()) <= {turns, turns + 1} and max(one.values()) <= 3
    assert 239 <= sum(a.values()) + sum(b.values()) <= 242


def test_counts_are_multinomial(spark):
    """Every shard's counts sum to its slots; over shards they have a multinomial's mean and variance."""
    share = {1: 0.5, 2: 0.3, 3: 0.15, 4: 0.05}
    total, upto, rows = 120_000.0, 0.0, []
    for k, p in share.items():
        upto += p * total
        rows.append((k, p * total, upto))
    got = {(r.shard, r.k): r.n for r in X.counts(spark.createDataFrame(rows, "k int, want double, upto double"), total, 3).collect()}
    shards = -(-120_000 // X.SHARD_SLOTS)
    for shard in range(shards):
        assert sum(got.get((shard, k), 0) for k in share) in (120_000 // shards, 120_000 // shards + 1)
    size = 120_000 / shards
    for k, p in share.items():
        own = [got.get((shard, k), 0) for shard in range(shards)]
        mean = sum(own) / shards
        assert mean == pytest.approx(size * p, abs=4 * (size * p * (1 - p) / shards) ** 0.5)
        assert sum((x - mean) ** 2 for x in own) / (shards - 1) == pytest.approx(size * p * (1 - p), rel=0.3)


def test_the_main_path_has_no_python(spark):
    plan = X.mixed(odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark):
    got = X.mixed(odd(spark)).collect()
    assert len(got) == len(odd_rows()) and {r.taken for r in got if r.size == 0} == {0} and all(r.taken <= 3 * r.size for r in got)
    assert X.mixed(none(spark)).collect() == []
    only_empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {r.taken for r in X.mixed(only_empty).collect()} == {0}


def test_rows_come_as_often_as_they_are_taken(spark):
    df = spark.createDataFrame(corpus(n=400), "doc_id long, text string, source string").withColumn("x", F.lit(1))
    took = {r.doc_id: r.taken / r.size for r in X.mixed(df).collect() if r.size}
    rows = X.resampled(df)
    assert rows.columns == df.columns
    for r in rows.groupBy("doc_id").count().collect():
        assert int(took[r.doc_id]) <= r["count"] <= int(took[r.doc_id]) + 1
    assert X.resampled(none(spark)).collect() == []
