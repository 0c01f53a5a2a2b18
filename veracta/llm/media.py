"""Cropped or edited copies of images, by local descriptors.

An image is a binary PGM (8 bit). Corners are found at several scales, in steps
of about an eighth; each gets 256 binary intensity tests whose pattern is turned
by the patch's own orientation. The corners of an image are the strongest of
each cell of a grid, so their number grows with the area and a crop finds its
own among them.

The Hamming tables join on keys of two neighbouring corners: sampled tests of
either, and coarsely how far, in which direction and how turned the second is as
seen from the first. One patch's tests say much the same, so strangers meet in a
key of one corner; they rarely do in two that also lie alike. The matches of two
images count if one similarity transform (from one match's places, scales and
orientations) brings enough others into place.

Equal bytes share one representative first. Images that share a key with another
are dealt into blocks, and all that share one are compared a pair of blocks at a
time, but for those that its links have joined already. An image goes to a pair
of blocks once, however many images of it share its keys, and only if one does;
no pairs of images are written. The pairs of blocks take turns, so that one
turn's shuffle is about what the images take.

A null or undecodable content, or one without corners, is in a class of its
own (undecodable equal bytes: of one class). Repeated rows stay, extra columns
are ignored, and an empty table gives an empty result. A very large image is
described whole: some 30 bytes of memory for each of its pixels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .storage import forget, materialise, only, relieve
from .textbatch import mix

#: ``CORNERS`` are for each cell of at most ``GRID`` by ``GRID`` pixels.
SCALES, CORNERS, GRID, BITS, WORDS = (1.0, 1.13, 1.28, 1.44, 1.63, 1.84, 2.07), (14, 12, 10, 8, 6, 5, 5), 96, 256, 8
#: Matches count once for each ``SPOT`` pixels square: a corner is often found at several scales.
MARGIN, NEAR_BITS, INLIERS, REACH, TURN, SIZE, SPOT = 8, 40, 6, 3.0, 0.5, 1.3, 6
#: Of a key: tests of each of two corners, tables, neighbours of a corner, how near and far they are in pixels of their scale, directions, ratio of distances.
SAMPLED, TABLES, NEIGHBOURS, NEAREST, FARTHEST, SECTORS, RATIO = 24, 2, 3, 4.0, 60.0, 8, 1.6
#: What one side of a pair of blocks holds on average, at most: images, and corners of theirs. Blocks there are if images allow, and images of the smallest.
BLOCK_IMAGES, BLOCK_CORNERS, BLOCKS, LEAST_IMAGES = 8192, 1 << 19, 8, 64
#: Bytes that one turn of pairs of blocks moves: as many times what the images take, or these if that is less.
TURN_SHARE, TURN_BYTES = 2, 1 << 28


def _tests(n: int, least: float = 7.0) -> np.ndarray:
    """Pairs of points, some way apart: what tests of nearer points say depends on noise."""
    rng, out = np.random.default_rng(20240), np.zeros((0, 4))
    while len(out) < n:
        p = np.clip(rng.normal(0, 3.2, (n, 4)), -6.5, 6.5)
        out = np.concatenate([out, p[np.hypot(p[:, 0] - p[:, 2], p[:, 1] - p[:, 3]) >= least]])
    return out[:n]


_PATTERN = _tests(BITS)
#: For each table the tests of the first and of the second corner.
_SAMPLES = [np.random.default_rng(100 + t).permutation(BITS)[: 2 * SAMPLED].reshape(2, SAMPLED) for t in range(TABLES)]
_HEAD = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode(content: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM, or None."""
    m = _HEAD.match(content or b"")
    if not m or int(m[3]) > 255 or not (w := int(m[1])) or not (h := int(m[2])) or len(content) < m.end() + w * h:
        return None
    return np.frombuffer(content, np.uint8, w * h, m.end()).reshape(h, w).astype(np.float32)


def pgm(pixels: np.ndarray) -> bytes:
    """The binary PGM of grey values."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares, edges repeated."""
    total = np.pad(np.pad(a, r, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * r + 1
    return (total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]) / n**2


def _shrunk(a: np.ndarray, by: float) -> np.ndarray:
    h, w = int(a.shape[0] / by), int(a.shape[1] / by)
    if by == 1 or min(h, w) < 2:
        return a
    y, x = (np.arange(h) + 0.5) * by - 0.5, (np.arange(w) + 0.5) * by - 0.5
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), a.shape[0] - 2), np.minimum(x.astype(int), a.shape[1] - 2)
    fy, fx = (y - y0)[:, None], x - x0
    return (a[np.ix_(y0, x0)] * (1 - fy) + a[np.ix_(y0 + 1, x0)] * fy) * (1 - fx) + (a[np.ix_(y0, x0 + 1)] * (1 - fy) + a[np.ix_(y0 + 1, x0 + 1)] * fy) * fx


_YY, _XX = np.mgrid[-7:8, -7:8]
_DISC = (_YY**2 + _XX**2) <= 49


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners as (x, y, scale, angle) in the image's own pixels, and their tests as rows of eight 32-bit words."""
    places, tests = [], []
    across, down = -(-image.shape[1] // GRID), -(-image.shape[0] // GRID)
    for scale, most in zip(SCALES, CORNERS, strict=True):
        a = _box(_shrunk(image, scale), 1)
        if min(a.shape) < 2 * MARGIN + 3:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        core = strength[MARGIN:-MARGIN, MARGIN:-MARGIN]
        peak = core > 1.0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    other = strength[MARGIN + dy : strength.shape[0] - MARGIN + dy, MARGIN + dx : strength.shape[1] - MARGIN + dx]
                    peak &= core >= other
        y, x = np.nonzero(peak)
        if not len(y):
            continue
        cell = (((y + MARGIN) * scale).astype(int) * down // image.shape[0]) * across + ((x + MARGIN) * scale).astype(int) * across // image.shape[1]
        order = np.lexsort((x, y, -core[y, x], cell))
        first = np.searchsorted(cell[order], cell[order])
        order = order[np.arange(len(order)) - first < most]
        y, x = y[order] + MARGIN, x[order] + MARGIN
        smooth, bits, angle = _box(a, 2), [], []
        for lo in range(0, len(y), 4096):
            i = slice(lo, lo + 4096)
            patch = a[y[i, None, None] + _YY, x[i, None, None] + _XX] * _DISC
            angle.append(np.arctan2((patch * _YY).sum((1, 2)), (patch * _XX).sum((1, 2))))
            c, s = np.cos(angle[-1])[:, None], np.sin(angle[-1])[:, None]
            at = [_between(smooth, s * px + c * py + y[i, None], c * px - s * py + x[i, None]) for px, py in ((_PATTERN[:, 0], _PATTERN[:, 1]), (_PATTERN[:, 2], _PATTERN[:, 3]))]
            bits.append(np.packbits(at[0] < at[1], axis=1).view("<u4"))
        tests += bits
        places.append(np.stack([(x + 0.5) * scale - 0.5, (y + 0.5) * scale - 0.5, np.full(len(x), scale), np.concatenate(angle)], axis=1))
    if not tests:
        return np.zeros((0, 4)), np.zeros((0, WORDS), np.uint32)
    return np.concatenate(places), np.concatenate(tests)


def _between(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between pixels, bilinear."""
    y, x = np.clip(y, 0, a.shape[0] - 1.001), np.clip(x, 0, a.shape[1] - 1.001)
    y0, x0 = y.astype(int), x.astype(int)
    fy, fx, flat, at = (y - y0).astype(np.float32), (x - x0).astype(np.float32), a.ravel(), y0 * a.shape[1] + x0
    upper = flat[at] * (1 - fx) + flat[at + 1] * fx
    return upper * (1 - fy) + (flat[at + a.shape[1]] * (1 - fx) + flat[at + a.shape[1] + 1] * fx) * fy


def keys(places: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """Distinct keys of pairs of neighbouring corners, of all tables."""
    if len(places) < 2:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.ascontiguousarray(tests).view(np.uint8), axis=1).astype(np.float32)
    power = (2.0 ** np.arange(SAMPLED)).astype(np.float32)  # whole numbers below 2 ** 24 are exact
    words = [[(bits[:, s] @ power).astype(np.uint64) for s in pair] for pair in _SAMPLES]
    out = []
    for scale in np.unique(places[:, 2]):
        own = np.flatnonzero(places[:, 2] == scale)
        x, y, angle = places[own, 0] / scale, places[own, 1] / scale, places[own, 3]
        step = max(1, (1 << 20) // len(own))
        for lo in range(0, len(own), step):
            dx, dy = x[None, :] - x[lo : lo + step, None], y[None, :] - y[lo : lo + step, None]
            far = np.hypot(dx, dy)
            far[far < NEAREST] = np.inf
            n = min(NEIGHBOURS, len(own))
            near = np.argpartition(far, n - 1, axis=1)[:, :n]
            i, k = np.nonzero(np.take_along_axis(far, near, 1) <= FARTHEST)
            j = near[i, k]
            heading = (np.arctan2(dy[i, j], dx[i, j]) - angle[lo + i]) % (2 * np.pi)
            turned = (angle[j] - angle[lo + i]) % (2 * np.pi)
            lie = [np.minimum(v * (SECTORS / (2 * np.pi)), SECTORS - 1).astype(np.uint64) for v in (heading, turned)]
            lie = (lie[0] * np.uint64(SECTORS) + lie[1]) * np.uint64(64) + (np.log(far[i, j]) / np.log(RATIO)).astype(np.uint64)
            for t, (one, two) in enumerate(words):
                out.append(mix(mix(lie * np.uint64(TABLES) + np.uint64(t) + (one[own[lo + i]] << np.uint64(32))) ^ (two[own[j]] * np.uint64(0x9E3779B97F4A7C15))))
    return np.unique(np.concatenate(out))


def consensus(a: np.ndarray, da: np.ndarray, b: np.ndarray, db: np.ndarray, least: int = 1) -> int:
    """The most places in ``a`` with a corner that one similarity transform takes to its match in ``b``; of less than ``least``, 0."""
    if not len(a) or not len(b):
        return 0
    near, j = np.full(len(a), BITS + 1), np.zeros(len(a), np.int64)
    da, db = (np.ascontiguousarray(x).view("<u8") for x in (da, db))
    differ = lambda x, k: np.bitwise_count(x[:, None, k] ^ db[None, :, k])
    step = max(1, (1 << 20) // len(b))  # a few tens of MB at once, however many corners there are
    for lo in range(0, len(a), step):
        half = differ(da[lo : lo + step], 0) + differ(da[lo : lo + step], 1)
        some = np.flatnonzero((half <= NEAR_BITS).any(1))  # half of the tests leave few corners whose other half matters
        away = half[some].astype(np.uint16) + differ(da[lo + some], 2) + differ(da[lo + some], 3)
        if len(some):
            j[lo + some], near[lo + some] = away.argmin(1), away.min(1)
    i = np.flatnonzero(near <= NEAR_BITS)
    if len(i) < INLIERS:
        return 0
    p, q = a[i], b[j[i]]
    size, turn = q[:, 2] / p[:, 2], q[:, 3] - p[:, 3]
    c, s = size * np.cos(turn), size * np.sin(turn)
    tx, ty = q[:, 0] - (c * p[:, 0] - s * p[:, 1]), q[:, 1] - (s * p[:, 0] + c * p[:, 1])
    spot = np.floor(p[:, :2].astype(np.float64) / SPOT).astype(np.int64)  # 32-bit numbers would run spots of a large image together
    spot = spot[:, 0] << 32 | spot[:, 1]
    most = least - 1
    for lo in range(0, len(i), step):  # each match's transform, tried on every other match
        k = slice(lo, lo + step)
        x = c[k, None] * p[None, :, 0] - s[k, None] * p[None, :, 1] + tx[k, None]
        y = s[k, None] * p[None, :, 0] + c[k, None] * p[None, :, 1] + ty[k, None]
        fits = np.hypot(x - q[None, :, 0], y - q[None, :, 1]) <= REACH
        # a corner that the transform takes to its match is also turned and resized by it
        fits &= np.abs((turn[k, None] - turn[None, :] + np.pi) % (2 * np.pi) - np.pi) <= TURN
        fits &= np.abs(np.log(size[k, None] / size[None, :])) <= np.log(SIZE)
        count = fits.sum(1)
        for r in np.argsort(-count, kind="stable"):
            if count[r] <= most:
                break
            most = max(most, len(np.unique(spot[fits[r]])))
    return most if most >= least else 0


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    given: set[int] = set()
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            some, rows = batch.slice(lo, 64), []
            some = some.filter(pa.array([(k := x.as_py()) not in given and not given.add(k) for x in some.column(0)], pa.bool_()))
            if not some.num_rows:
                continue
            for content in some.column(1):
                image = decode(content.as_py())
                at, keys = describe(image) if image is not None else (np.zeros((0, 4)), np.zeros((0, WORDS), np.uint32))
                rows.append((at.astype("<f4").tobytes(), keys.astype("<u4").tobytes()))
            cols = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([some.column(0), *cols], names=["rep", "places", "tests"])


def _arrays(places: pa.Scalar, tests: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(places.as_buffer(), "<f4").reshape(-1, 4), np.frombuffer(tests.as_buffer(), "<u4").reshape(-1, WORDS)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of each image."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            found = [keys(*_arrays(*x)) for x in zip(some.column("places"), some.column("tests"), strict=True)]
            rep = np.repeat(some.column("rep").to_numpy(), [len(k) for k in found])
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.concatenate(found).view(np.int64))], names=["rep", "key"])


def _sharing(keys: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of ``left`` share a key with which of ``right``; ``row`` has each key's row."""
    at = np.full(max(left.max(initial=0), right.max(initial=0), row.max(initial=0)) + 1, -1)
    out, sides = np.zeros((len(left), len(right)), bool), []
    for side in (left, right):
        at[:] = -1
        at[side] = np.arange(len(side))
        own = at[row] >= 0
        order = np.argsort(keys[own], kind="stable")
        found, start, count = np.unique(keys[own][order], return_index=True, return_counts=True)
        sides.append((found, start, count, at[row][own][order]))
    (found, start, count, rows), (others, begin, number, columns) = sides
    _, i, k = np.intersect1d(found, others, assume_unique=True, return_indices=True)
    for lo, n, first, m in zip(start[i].tolist(), count[i].tolist(), begin[k].tolist(), number[k].tolist(), strict=True):
        out[rows[lo : lo + n, None], columns[first : first + m]] = True
    return out


def _joined(inliers: int):
    """Of the images of a pair of blocks, links that join all classes which any link between two that share a key joins."""

    def run(table: pa.Table) -> pa.Table:
        rep, block = (table.column(c).to_numpy() for c in ("rep", "block"))
        keys = table.column("keys").combine_chunks()
        many = keys.value_lengths().to_numpy()
        image = [_arrays(*x) for x in zip(table.column("places"), table.column("tests"), strict=True)]
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        order = np.lexsort((rep, -many))  # those with most shared keys come first
        left, right, out = order[block[order] == x], order[block[order] == y], []
        share = _sharing(keys.flatten().to_numpy(), np.repeat(np.arange(len(rep)), many), left, right)
        label = np.arange(len(rep))
        for n, i in enumerate(left):
            if x == y:
                share[n, : n + 1] = False
            j = right[share[n]]
            j = j[label[j] != label[i]]
            # of each class one, then two, four and so on: the first link makes the rest needless
            j = j[np.argsort(label[j], kind="stable")]
            rank, most = np.arange(len(j)) - np.searchsorted(label[j], label[j]), 1
            while len(j):
                some, j, rank = j[rank < most], j[rank >= most], rank[rank >= most]
                for k in some:
                    a, b = (i, k) if rep[i] < rep[k] else (k, i)
                    if label[a] != label[b] and consensus(*image[a], *image[b], inliers) >= inliers:
                        out.append((int(rep[a]), int(rep[b])))
                        label[label == label[b]] = label[a]
                still = label[j] != label[i]
                j, rank, most = j[still], rank[still], 2 * most + 1
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _links(images: DataFrame, inliers: int, block: int) -> DataFrame:
    """Links ``a, b`` that join all classes which any link between two of ``images(rep, places, tests)`` that share a key
    joins. The files of ``images`` are deleted."""
    n, corners, held = (x or 0 for x in images.agg(F.count("*"), F.sum(F.octet_length("places") / 16), F.sum(F.octet_length("places") + F.octet_length("tests"))).first())
    blocks = max(-(-n // block), int(-(-corners // BLOCK_CORNERS)), min(BLOCKS, n // LEAST_IMAGES), 1)
    mine = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")

    same = Window.partitionBy("key")
    placed = images.mapInArrow(_keyed, "rep long, key long").withColumn("size", F.count("*").over(same)).where("size > 1")
    placed = placed.withColumn("blocks", F.collect_set(mine).over(same))
    met = materialise(placed.groupBy("rep").agg(F.collect_list("key").alias("keys"), F.flatten(F.collect_set("blocks")).alias("blocks")), "media-met")
    relieve(images.sparkSession, 0)
    past, images = images, materialise(images.join(met.withColumn("blocks", F.array_distinct("blocks")), "rep").withColumn("block", mine), "media-sharing")
    forget(past)
    forget(met)
    relieve(images.sparkSession, 0)

    bytes_, pairs = F.octet_length("places") + F.octet_length("tests") + 8 * F.size("keys"), blocks * (blocks + 1) // 2
    moved = images.agg(F.sum(bytes_ * F.size("blocks"))).first()[0] or 0
    turns = min(pairs, max(1, -(-moved // max(TURN_BYTES, TURN_SHARE * int(held)))))
    tasks = min(4 * -(-pairs // turns), 10 * images.sparkSession.sparkContext.defaultParallelism)
    nth = f"least(block, k) * (2L * {blocks} - least(block, k) + 1) div 2 + abs(block - k)"  # of the pair of blocks
    found = []
    for turn in range(turns):
        own = images.withColumn("other", F.explode(F.expr(f"filter(blocks, k -> ({nth}) % {turns} = {turn})")))
        own = own.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("blocks", "other").repartition(tasks, "x", "y")
        found.append(materialise(own.groupBy("x", "y").applyInArrow(_joined(inliers), "a long, b long"), "media-links"))
        relieve(images.sparkSession, 0)  # or this turn's shuffle files would stay beside the next one's
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    out = materialise(links, "media-all-links")
    for table in (images, *found):
        forget(table)
    return out


def media_copies(media: DataFrame, inliers: int = INLIERS, block: int = BLOCK_IMAGES) -> DataFrame:
    """One row for each row of ``media(media_id, content)``: ``media_id``, ``class_id`` (least id of its class),
    ``n_copies`` (rows with the same bytes)."""
    rows = media.select(F.col("media_id").cast("long").alias("media_id"), F.col("content").cast("binary").alias("content"))
    rows = rows.withColumns({"md": F.sha2("content", 256), "mark": F.xxhash64("content")})
    every = materialise(rows.select("media_id", "md", "mark"), "media")
    own = every.where("md is not null and media_id is not null").groupBy("md", "mark", "media_id").agg(F.count("*").alias("n"))
    copies = own.groupBy("md").agg(F.min("media_id").alias("rep"), F.sum("n").alias("n_copies"), F.max("n").alias("most"), F.first("mark").alias("mark"))
    copies = materialise(copies, "media-copies")
    # contents don't move: they are described where they are read
    chosen = only(rows, copies.select("mark", F.col("rep").alias("media_id")), ["mark", "media_id"])
    described = chosen.select("media_id", "content").mapInArrow(_described, "rep long, places binary, tests binary")
    if copies.where("most > 1").head(1):  # rows that are repeated whole
        described = described.dropDuplicates(["rep"])
    images = materialise(described, "images")

    links = _links(images, inliers, block)
    classes = components(links)
    forget(links)

    member = copies.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("md", F.coalesce("class", "rep").alias("class"), "n_copies")
    out, own = every.select("media_id", "md").join(member, "md", "left"), F.col("media_id").isNull() | F.col("class").isNull()
    return out.select(
        "media_id",
        F.when(own, F.col("media_id")).otherwise(F.col("class")).alias("class_id"),
        F.when(own, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
    )


CELLS, CELL, PLANES = 4, 24, 16


def _planes(width: int) -> np.ndarray:
    """Fixed random directions, ``PLANES`` for each cell of a picture."""
    return np.random.default_rng(7).normal(size=(width, CELLS * CELLS * PLANES)).astype(np.float32)


def picture(vector: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """A collage: each cell has a texture of its own for the side of its planes that the vector is on. Vectors that are
    nearly equal share most cells, as an edited copy shares most of an image; others share none."""
    sides = (vector @ planes > 0).reshape(CELLS * CELLS, PLANES)
    code = sides @ (1 << np.arange(PLANES, dtype=np.uint64)) + (np.arange(CELLS * CELLS, dtype=np.uint64) << np.uint64(PLANES))
    noise = mix(mix(code)[:, None] + np.arange(CELL * CELL, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    whole = noise.reshape(CELLS, CELLS, CELL, CELL).transpose(0, 2, 1, 3).reshape(CELLS * CELL, CELLS * CELL).astype(np.float32)
    smooth = _box(_box(whole, 1), 1)
    return 128 + 45 * (smooth - smooth.mean()) / (smooth.std() + 1e-9)


def rendered(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``media_id, content``: pictures made from vectors, since the tables have none. A null vector, or one with a null,
    gives a null."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for v in batch.column(1):
                v = v.as_py()
                if not v or None in v:
                    out.append(None)
                    continue
                if len(v) not in planes:
                    planes[len(v)] = _planes(len(v))
                out.append(pgm(picture(np.array(v, np.float32), planes[len(v)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["media_id", "content"])

    return vectors.select(F.col(ident).cast("long").alias("media_id"), F.col(column).alias("v")).mapInArrow(draw, "media_id long, content binary")
