import numpy as np
import pyarrow as pa
import pytest

from veracta.llm import media as M


def images(n=6, seed=1):
    rng, planes = np.random.default_rng(seed), M._planes(64)
    return [M.decode(M.pgm(M.picture(rng.normal(size=64).astype(np.float32), planes))) for _ in range(n)]


EDITS = {
    "cropped": lambda a: a[9:, 12:], "brighter": lambda a: np.clip(a * 1.2 + 10, 0, 255), "turned": lambda a: np.rot90(a).copy(), "smaller": lambda a: M._shrunk(a, 1.5),
    "noisy": lambda a: np.clip(a + np.random.default_rng(3).normal(0, 5, a.shape), 0, 255),
}


@pytest.mark.parametrize("edit", EDITS)
def test_an_edited_copy_agrees_and_a_stranger_does_not(edit):
    own = [M.describe(a) for a in images()]
    for k, a in enumerate(images()):
        b = M.describe(M.decode(M.pgm(EDITS[edit](a))))
        assert M.consensus(*own[k], *b) >= M.INLIERS
        assert M.consensus(*own[(k + 1) % len(own)], *b) < M.INLIERS


def large(seed, cells=4):
    """A picture of several small ones side by side."""
    some = images(cells * cells, seed)
    return np.concatenate([np.concatenate(some[r * cells : (r + 1) * cells], axis=1) for r in range(cells)])


@pytest.mark.parametrize("share", [2, 4, 16])
def test_crops_of_larger_pictures_agree(share):
    for seed in range(3):
        a, other = large(seed), large(seed + 50)
        h, w = a.shape[0] // (1 if share == 2 else int(share**0.5)), a.shape[1] // (2 if share == 2 else int(share**0.5))
        top, left = (a.shape[0] - h) // 3, (a.shape[1] - w) // 3
        crop = M.describe(np.clip(a[top : top + h, left : left + w] * 1.1 + 3, 0, 255))
        assert M.consensus(*crop, *M.describe(a)) >= M.INLIERS
        assert M.consensus(*crop, *M.describe(other)) < M.INLIERS


RECALL = {
    "crop to half": (lambda a: a[12:80, 14:82], 0.9), "resize 1.1": (lambda a: M._shrunk(a, 1.1), 0.9), "resize 1.2": (lambda a: M._shrunk(a, 1.2), 0.8), "resize 1.5": (lambda a: M._shrunk(a, 1.5), 0.3),
    "turn": (lambda a: np.rot90(a, 3).copy(), 0.9), "noise": (lambda a: np.clip(a + np.random.default_rng(5).normal(0, 14, a.shape), 0, 255), 0.9), "brightness": (lambda a: np.clip(a * 0.7 + 20, 0, 255), 0.9),
}


@pytest.mark.parametrize("edit", RECALL)
def test_share_of_edited_copies_found(edit):
    """A copy is found if it shares a key with its original and the verification takes it."""
    made, least = RECALL[edit]
    found = 0
    for a in images(40, 33):
        one, two = M.describe(a), M.describe(M.decode(M.pgm(made(a))))
        found += len(np.intersect1d(M.keys(*one), M.keys(*two))) > 0 and M.consensus(*two, *one) >= M.INLIERS
    assert found >= least * 40


def test_strangers_rarely_meet_and_never_agree():
    own = [M.describe(a) for a in images(60, 44)]
    found = [M.keys(*d) for d in own]
    pairs = [(i, k) for i in range(60) for k in range(i)]
    assert max(M.consensus(*own[i], *own[k]) for i, k in pairs) < M.INLIERS
    assert sum(len(np.intersect1d(found[i], found[k])) > 0 for i, k in pairs) < 0.005 * len(pairs)


@pytest.mark.parametrize("block", [M.BLOCK_IMAGES, 2])
def test_candidates_are_those_of_all_pairs(spark, block):
    """Copies that share a key and that the verification takes are in one class, as comparing every pair puts them."""
    rng, own = np.random.default_rng(9), images(16, 21)
    made = [(k, a) for k, a in enumerate(own)]
    made += [(100 * n + k, np.clip(a + rng.normal(0, 14, a.shape), 0, 255)) for n in (1, 2, 3) for k, a in enumerate(own)]
    made += [(400 + k, M._shrunk(np.clip(a + rng.normal(0, 6, a.shape), 0, 255), 1.25)) for k, a in enumerate(own)]
    made += [(500 + k, M._shrunk(a, 1.8)) for k, a in enumerate(own)]
    content = {i: M.pgm(a) for i, a in made}
    described = {i: M.describe(M.decode(c)) for i, c in content.items()}
    keyed = {i: M.keys(*d) for i, d in described.items()}
    links = [(i, k) for i in described for k in described if i < k and len(np.intersect1d(keyed[i], keyed[k])) and M.consensus(*described[i], *described[k]) >= M.INLIERS]
    assert len(links) > 60 and sum(k >= 400 for _, k in links) > 9 and all(i % 100 == k % 100 for i, k in links)
    got = {r.media_id: r.class_id for r in M.media_copies(spark.createDataFrame(list(content.items()), "media_id long, content binary"), block=block).collect()}
    assert [(i, k) for i, k in links if got[i] != got[k]] == []
    assert all(c % 100 == i % 100 for i, c in got.items())


def test_a_pair_of_blocks_joins_what_every_pair_would():
    """Its links give the classes of comparing all that share a key, whatever the order of rows, and none more than it takes."""
    rng, own = np.random.default_rng(4), images(5, 61)
    made = own + [np.clip(a + rng.normal(0, 8, a.shape), 0, 255) for _ in range(5) for a in own]
    described = [M.describe(M.decode(M.pgm(a))) for a in made]
    keyed = [M.keys(*d).view(np.int64) for d in described]
    columns = {"rep": list(range(30)), "block": [k % 2 for k in range(30)], "keys": keyed, "x": [0] * 30, "y": [1] * 30}
    columns |= {"places": [d[0].astype("<f4").tobytes() for d in described], "tests": [d[1].astype("<u4").tobytes() for d in described]}
    table = pa.table(columns, schema=pa.schema([("rep", pa.int64()), ("block", pa.int32()), ("keys", pa.list_(pa.int64())), ("x", pa.int32()), ("y", pa.int32()), ("places", pa.binary()), ("tests", pa.binary())]))
    for order in (np.arange(30), rng.permutation(30)):
        got = M._joined(M.INLIERS)(table.take(pa.array(order)))
        pairs = list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
        assert len(pairs) == 25 and all(a < b and a % 5 == b % 5 and a % 2 != b % 2 for a, b in pairs)


def test_what_moves_is_bounded_by_the_images(spark, monkeypatch):
    """Images that share a key with many others move to a pair of blocks once, and no more in a turn than the images take, some times."""
    own = images(4, 71)
    rng = np.random.default_rng(8)
    rows = [(100 * n + k, M.pgm(np.clip(a + rng.normal(0, 6, a.shape), 0, 255))) for n in range(6) for k, a in enumerate(own)]
    names, write = [], M.materialise
    monkeypatch.setattr(M, "materialise", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(M, "TURN_BYTES", 1)
    got = {r.media_id: r.class_id for r in M.media_copies(spark.createDataFrame(rows, "media_id long, content binary"), block=6).collect()}
    assert all(c == i % 100 for i, c in got.items()) and len(got) == 24
    assert names.count("media-links") > 1


def test_spots_of_a_large_picture_stay_apart():
    """Six places that differ by one spot each, far from the left edge, in 32-bit numbers as the tables hold them."""
    at = np.array([[6100 + 3, 6 * k + 3, 1, 0] for k in range(12)], np.float32)
    tests = np.random.default_rng(2).integers(0, 1 << 32, (12, M.WORDS), dtype=np.uint64).astype(np.uint32)
    assert M.consensus(at, tests, at, tests) == 12


def test_classes(spark):
    rows = []
    for k, a in enumerate(images()):
        rows.append((k * 100, M.pgm(a)))
        rows += [(k * 100 + i + 1, M.pgm(EDITS[e](a))) for i, e in enumerate(EDITS)]
        rows.append((k * 100 + 50, M.pgm(a)))
    rows += [(900, None), (901, b"no image"), (902, b"no image"), (903, b""), (904, M.pgm(np.full((64, 64), 9.0))), (None, b"x"), (0, M.pgm(images()[0]))]
    got = M.media_copies(spark.createDataFrame([(*r, "x") for r in rows], "media_id long, content binary, class_id string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.media_id is not None and r.media_id < 900:
            assert r.class_id == r.media_id // 100 * 100
    by = {r.media_id: (r.class_id, r.n_copies) for r in got}
    assert by[900] == (900, 1) and by[902] == (901, 2) and by[904] == (904, 1) and by[None] == (None, 1) and by[50] == (0, 3)
    assert M.media_copies(spark.createDataFrame([], "media_id long, content binary")).collect() == []


def test_pictures_of_vectors(spark):
    df = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, [0.1, None]), (4, [])], "vec_id long, embedding array<float>")
    got = {r.media_id: r.content for r in M.rendered(df).collect()}
    assert M.decode(bytes(got[1])).shape == (M.CELLS * M.CELL,) * 2 and got[2] is None and got[3] is None and got[4] is None
