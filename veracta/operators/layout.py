"""Printed labels found among a page's words, and the field boxes that they bound.

Everything is keyed by document, so a corpus is one job. Labels come from a
template and are few; candidate spans are made once for each line and length,
and lengths that can't reach the threshold never get to the fuzzy function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.fuzzy import can_reach, similarity
from ..functions.text import normal

LONG, SHORT, SHORT_LABEL, SAME_PLACE = 78, 85, 6, 0.3


def seen_words(words: DataFrame, least: float = 15) -> DataFrame:
    """OCR words that say something and are sure enough."""
    return words.where((F.trim("text") != "") & (F.col("confidence") >= least))


def lines(words: DataFrame) -> DataFrame:
    """``doc_id, line_id, words, text, x, y, w, h``: words of a line by x, and the box around them."""
    box = F.struct("x", "y", "w", "h", "text")
    out = words.groupBy("doc_id", "line_id").agg(
        F.array_sort(F.collect_list(box)).alias("words"), F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
    )
    return out.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " "))


def spans(page: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every run of words in a line whose length is in ``sizes(size)``: ``doc_id, line_id, size, start, text, x, y, w, h``."""
    lengths = sizes.agg(F.sort_array(F.collect_set("size")).alias("sizes"))
    # one row of a template's few lengths, sent to every task
    runs = page.join(F.broadcast(lengths)).select("doc_id", "line_id", "words", F.explode("sizes").alias("size")).where(F.col("size") <= F.size("words"))
    runs = runs.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("start"))
    runs = runs.withColumn("span", F.slice("words", F.col("start"), F.col("size")))
    last = F.element_at("span", -1)
    top, bottom = F.array_min(F.transform("span", lambda w: w["y"])), F.array_max(F.transform("span", lambda w: w["y"] + w["h"]))
    left = F.col("span")[0]["x"]
    return runs.select("doc_id", "line_id", "size", "start", F.array_join(F.transform("span", lambda w: w["text"]), " ").alias("text"), left.alias("x"), top.alias("y"), (last["x"] + last["w"] - left).alias("w"), (bottom - top).alias("h"))


def candidates(page: DataFrame, labels: DataFrame, long: float = LONG, short: float = SHORT) -> DataFrame:
    """Each line's best span for each label that it resembles enough: ``doc_id, label, label_ord, line_id, score, x, y, w, h, text``.

    ``labels(label, label_ord)`` are a template's, so they are sent to every task. Spans are of one word fewer than the
    label to two more; ties go to the shorter span, then the one further left.
    """
    n = F.size(F.split(F.trim("label"), "\\s+"))
    asked = labels.select("label", "label_ord", n.alias("n"), F.when(F.char_length("label") < SHORT_LABEL, short).otherwise(long).cast("double").alias("need"))
    by_size = asked.select("*", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - 1), F.col("n") + 2)).alias("size"))
    pairs = spans(page, by_size.select("size")).join(F.broadcast(by_size), "size").withColumns({"a": normal(F.col("label")), "b": normal(F.col("text"))})
    pairs = pairs.where(can_reach(F.col("a"), F.col("b"), short if short < long else long)).withColumn("score", similarity(F.col("a"), F.col("b")))
    best = pairs.groupBy("doc_id", "label", "label_ord", "line_id").agg(F.max(F.struct("score", (-F.col("size")).alias("s"), (-F.col("start")).alias("t"), "x", "y", "w", "h", "text")).alias("b"), F.first("need").alias("need"))
    return best.where(F.col("b.score") >= F.col("need")).select("doc_id", "label", "label_ord", "line_id", "b.score", "b.x", "b.y", "b.w", "b.h", "b.text")


def gap_clusters(rows: DataFrame, by: str, x: str, gap: Column, name: str = "cluster") -> DataFrame:
    """``rows`` with a cluster number from 0 for each ``by``: a new one begins where ``x`` is further than ``gap`` from the one before."""
    order = Window.partitionBy(by).orderBy(x)
    jump = F.coalesce((F.col(x) - F.lag(x).over(order) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_jump", jump).withColumn(name, F.sum("_jump").over(order.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_jump")


def form_column(found: DataFrame, pages: DataFrame, ink: DataFrame | None = None, least: int = 4, shared: float = 0.5) -> DataFrame:
    """``found`` candidates without those of other copies of a form on the same page.

    Columns are clusters of x. One column with enough labels keeps its own; several are copies if two of them share
    half of their labels or more, and then the one with most labels, weighed by ``ink(doc_id, col, ink_ratio)``, stays.
    """
    page = pages.select("doc_id", "page_w")
    at = gap_clusters(found.join(page, "doc_id"), "doc_id", "x", F.greatest(F.lit(40), (F.col("page_w") * 0.15).cast("int")), "col")
    cols = at.groupBy("doc_id", "col").agg(F.collect_set("label").alias("labels")).where(F.size("labels") >= least)
    one, two = cols.select("doc_id", F.col("col").alias("c1"), F.col("labels").alias("l1")), cols.select("doc_id", F.col("col").alias("c2"), F.col("labels").alias("l2"))
    copies = one.join(two, "doc_id").where("c1 < c2").groupBy("doc_id").agg(F.max(F.size(F.array_intersect("l1", "l2")) / F.least(F.size("l1"), F.size("l2"))).alias("overlap"))
    weight = cols.join(ink, ["doc_id", "col"], "left") if ink is not None else cols.withColumn("ink_ratio", F.lit(0.0))
    best = weight.groupBy("doc_id").agg(F.max(F.struct((F.size("labels") * (0.25 + F.coalesce("ink_ratio", F.lit(0.0)))).alias("s"), (-F.col("col")).alias("c"))).alias("b"), F.count("*").alias("n"))
    keep = best.join(copies, "doc_id", "left").select("doc_id", (-F.col("b.c")).alias("keep"), ((F.col("n") == 1) | (F.coalesce("overlap", F.lit(0.0)) >= shared)).alias("narrow"))
    return at.join(keep, "doc_id", "left").where(~F.coalesce("narrow", F.lit(False)) | (F.col("col") == F.col("keep"))).select(*found.columns)


def overlap(ax: int, aw: int, bx: int, bw: int) -> float:
    """Of two stretches, as a share of the shorter one."""
    return max(0, min(ax + aw, bx + bw) - max(ax, bx)) / max(1, min(aw, bw))


def greedy(found: DataFrame, needed: DataFrame, most: float = SAME_PLACE) -> DataFrame:
    """Candidates taken best first, each label as often as ``needed(label, needed)``, none on a place that is taken.

    Each choice depends on those before it, so a document is one group; it has as many rows as a page has labels.
    """
    cols = found.columns

    def choose(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["score", "label_ord", "line_id", "x"], ascending=[False, True, True, True], kind="stable")
        taken: dict[int, list[tuple[int, int]]] = {}
        count: dict[str, int] = {}
        kept = []
        for i, r in zip(page.index, page.itertuples(index=False), strict=True):
            places = taken.setdefault(r.line_id, [])
            if count.get(r.label, 0) < r.needed and all(overlap(r.x, r.w, *p) <= most for p in places):
                places.append((r.x, r.w))
                count[r.label] = count.get(r.label, 0) + 1
                kept.append(i)
        return page.loc[kept, cols]

    return found.join(F.broadcast(needed), "label").groupBy("doc_id").applyInPandas(choose, found.schema)


def occurrences(chosen: DataFrame) -> DataFrame:
    """``occurrence``: which of its label's hits a row is, from the top."""
    return chosen.withColumn("occurrence", F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("y", "line_id", "x")))


def in_order(anchors: DataFrame, least: int = 3) -> DataFrame:
    """The longest run of anchors whose y doesn't fall in template order (``ord``); the first such run on ties.
    Fewer than ``least`` stay as they are."""

    def keep(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["ord", "y"], kind="stable").reset_index(drop=True)
        if len(page) < least:
            return page
        ys = page["y"].tolist()
        length, before = [1] * len(ys), [-1] * len(ys)
        for i, y in enumerate(ys):
            for j in range(i):
                if ys[j] <= y and length[j] >= length[i]:
                    length[i], before[i] = length[j] + 1, j
        at, kept = length.index(max(length)), []
        while at >= 0:
            kept.append(at)
            at = before[at]
        return page.loc[sorted(kept)]

    return anchors.groupBy("doc_id").applyInPandas(keep, anchors.schema)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least squares and the median residual of each row's ``pairs``, in extended precision, rounded once at the end."""
    for batch in batches:
        lists, n_rows = batch.column("pairs"), batch.num_rows
        pairs, group = lists.flatten(), np.repeat(np.arange(n_rows), np.diff(lists.offsets.to_numpy()))
        x, y = (pairs.field(k).to_numpy(zero_copy_only=False).astype(np.longdouble) for k in (0, 1))
        n = np.bincount(group, minlength=n_rows)
        own = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[own]
        out = np.zeros((3, n_rows))
        known = np.zeros(n_rows, bool)
        if len(own):
            at, count = np.repeat(np.arange(len(own)), n[own]), n[own]
            mx, my = (np.add.reduceat(v, first) / count for v in (x, y))
            dx, dy = x - mx[at], y - my[at]
            known[own] = np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first)
            with np.errstate(divide="ignore", invalid="ignore"):
                slope = np.add.reduceat(dx * dy, first) / np.add.reduceat(dx * dx, first)
                start = my - slope * mx
                away = np.abs(slope[at] * x + start[at] - y)
            away = away[np.lexsort((away, at))]
            middle = (away[first + (count - 1) // 2] + away[first + count // 2]) / 2
            out[:, own] = slope, start, middle
        cols = [pa.array(v, pa.float64(), mask=~known) for v in out]
        names = [k for k in batch.schema.names if k != "pairs"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *cols], names=[*names, "slope", "intercept", "residual"])


def fit(anchors: DataFrame) -> DataFrame:
    """For each document: the line ``y = slope * rel_y + intercept``, its median residual, and the anchors' medians.

    Sums of doubles depend on the order in which tasks deliver them, which shows where a result is to be rounded; these
    don't. A document is one list, as long as a page has anchors.
    """
    pair = F.struct(F.col("rel_y").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("rel_y").isNotNull() & F.col("y").isNotNull(), pair))).alias("pairs")
    rows = anchors.where("doc_id is not null").groupBy("doc_id").agg(
        pairs, F.count("rel_y").alias("points"), F.count("*").alias("n_found"),
        F.percentile("x", F.lit(0.2)).cast("int").alias("left"), F.median("h").alias("median_h"),
    )
    schema = StructType([f for f in rows.schema if f.name != "pairs"] + [StructField(k, DoubleType()) for k in ("slope", "intercept", "residual")])
    line = rows.mapInArrow(_lines, schema).withColumn("residual", F.when(F.col("points") >= 3, F.coalesce("residual", F.lit(0.0))).otherwise(0.0))
    return line.select("doc_id", "slope", "intercept", "points", "n_found", "left", "median_h", "residual")


def interpolated(anchors: DataFrame, template: DataFrame, fitted: DataFrame) -> DataFrame:
    """``anchors(doc_id, id, x, y, w, h)`` and, where two or more are found, the template's others on the fitted line."""
    missing = fitted.where("points >= 2 and slope is not null").join(F.broadcast(template.where("rel_y is not null"))).join(anchors.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    h = F.col("median_h").cast("int")
    made = missing.select("doc_id", "id", F.col("left").alias("x"), (F.col("slope") * F.col("rel_y") + F.col("intercept")).cast("int").alias("y"), (F.char_length("label") * h * 0.55).cast("int").alias("w"), h.alias("h"), F.lit(True).alias("interpolated"))
    return anchors.select("doc_id", "id", "x", "y", "w", "h", F.lit(False).alias("interpolated")).unionByName(made)


def coverage(found: DataFrame, fields: DataFrame) -> DataFrame:
    """For each document, the share of the anchors that bound fields which are really found."""
    ends = fields.select(F.explode(F.array("anchor", "until")).alias("id")).where("id is not null and id <> 'none' and id <> ''").distinct()
    total = ends.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    return found.select("doc_id", "id").distinct().join(F.broadcast(ends.withColumn("bounds", F.lit(1))), "id", "left").groupBy("doc_id").agg(F.count("bounds").alias("n")).join(F.broadcast(total)).select("doc_id", (F.col("n") / F.col("total")).alias("coverage"))


def reliable(n_found: Column, points: Column, residual: Column, median_h: Column, covered: Column, min_anchors: int = 8, min_coverage: float = 0.6) -> Column:
    return (n_found >= min_anchors) & ((points < 3) | (residual <= 2.5 * median_h)) & (covered >= min_coverage)


def field_boxes(anchors: DataFrame, fields: DataFrame, pages: DataFrame, clamp: DataFrame | None = None) -> DataFrame:
    """``doc_id, field, kind, x, y, w, h, interpolated`` of the template's ``fields(field, kind, anchor, until,
    include_anchor_line, pad)`` on pages ``(doc_id, page_w, page_h)``; ``clamp(doc_id, lo, hi)`` bounds a form's column."""
    real = ~F.col("interpolated")
    x2 = F.max(F.when(real, F.col("x") + F.col("w")))
    page = pages.join(anchors.groupBy("doc_id").agg(F.percentile(F.when(real, F.col("x")), F.lit(0.1)).cast("int").alias("p10"), x2.alias("x2"), F.count("*").alias("n")), "doc_id")
    lo = F.coalesce("p10", (F.col("page_w") * 0.05).cast("int"))
    hi = F.least(F.col("page_w") - 4, F.coalesce("x2", "page_w") + (F.col("page_w") * 0.08).cast("int"))
    if clamp is not None:
        page = page.join(clamp, "doc_id", "left")
        lo, hi = F.greatest(lo, F.coalesce("lo", lo)), F.least(hi, F.coalesce("hi", hi))
    page = page.withColumns({"left": lo, "right": hi})
    end = anchors.select("doc_id", F.col("id").alias("until"), F.col("y").alias("end_y"))
    rows = anchors.join(F.broadcast(fields), F.col("id") == F.col("anchor")).drop("id").join(end, ["doc_id", "until"], "left").join(page, "doc_id")
    beside, h = F.col("kind") == "right_of", F.col("h")
    x = F.when(beside, F.col("x") + F.col("w") + 4).otherwise(F.col("left"))
    top = F.when(beside, F.col("y") - (0.7 * h).cast("int")).otherwise(F.col("y") + F.when(F.coalesce("include_anchor_line", F.lit(True)), -(0.6 * h).cast("int")).otherwise(h))
    low = F.coalesce(F.col("end_y") - 2, F.when(beside, F.col("y") + (2.0 * h).cast("int")).otherwise(F.least(F.col("page_h"), F.col("y") + 4 * h)))
    w = F.when(beside, F.greatest(F.lit(10), F.col("right") - x)).otherwise(F.col("right") - F.col("left"))
    pad = F.coalesce("pad", F.lit(4))
    px, py = F.greatest(F.lit(0), x - pad), F.greatest(F.lit(0), F.greatest(F.lit(0), top) - pad)
    return rows.where(F.col("kind").isin("right_of", "band")).select(
        "doc_id", "field", "kind", px.alias("x"), py.alias("y"), F.least(F.col("page_w") - px, w + 2 * pad).alias("w"),
        F.least(F.col("page_h") - py, F.greatest(h, low - top) + 2 * pad).alias("h"), "interpolated",
    )


def detect_template(page: DataFrame, templates: DataFrame, first: int = 40) -> DataFrame:
    """``doc_id, template_id``: the first template whose keyword is in a page's first lines, else the first without a
    keyword, else the first. ``templates(template_id, ord, keyword)`` are a pack's few."""
    top = page.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("y", "line_id"))).where(F.col("k") <= first)
    text = top.groupBy("doc_id").agg(normal(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda t: t["text"]), " ")).alias("t"))
    keyed = ~(F.coalesce(F.col("keyword"), F.lit("")) == "")
    tier = F.when(keyed & F.contains("t", normal(F.col("keyword"))), 0).when(~keyed, 1).otherwise(2)
    return text.join(F.broadcast(templates)).groupBy("doc_id").agg(F.min_by("template_id", F.struct(tier, "ord")).alias("template_id"))


def relative_y(page: DataFrame) -> DataFrame:
    """``rel_y``: where a line stands between its document's first and last."""
    every = Window.partitionBy("doc_id")
    low, high = F.min("y").over(every), F.max("y").over(every)
    return page.withColumn("rel_y", (F.col("y") - low) / F.greatest(F.lit(1), high - low))


def detect_country(texts: DataFrame, packs: DataFrame, fallback: str = "zz") -> DataFrame:
    """``doc_id, country, hits``: the pack with most keywords in a text, the earliest on ties, the fallback
    without any; a keyword that folds like another counts too. All ``packs(country, ord, keywords)`` are one row, which
    is sent to every task, so that a text is read once, where it is, and its row is the result's."""
    keys = F.transform("keywords", lambda k: normal(k)).alias("keys")
    known = packs.agg(F.array_sort(F.collect_list(F.struct("ord", "country", keys))).alias("packs"))
    rows = texts.select("doc_id", normal(F.col("text")).alias("t")).join(F.broadcast(known))

    def hits(pack: Column) -> Column:
        n = F.size(F.filter(pack["keys"], lambda k: F.contains(F.col("t"), k)))
        return F.struct(n.alias("hits"), (-pack["ord"]).alias("o"), pack["country"].alias("country"))

    best = rows.select("doc_id", F.array_max(F.transform("packs", hits)).alias("b"))
    return best.select("doc_id", F.when(F.col("b.hits") > 0, F.col("b.country")).otherwise(fallback).alias("country"), F.col("b.hits").alias("hits"))


def best_rotation(yields: DataFrame, enough: int = 150, floor: int = 40, factor: float = 1.3) -> DataFrame:
    """``doc_id, rotation`` from ``yields(doc_id, ord, rotation, chars)``: upright if that reads enough characters, else
    the one that reads most, if it beats upright clearly."""
    up = F.max(F.when(F.col("rotation") == 0, F.col("chars")))
    best = F.max(F.struct("chars", (-F.col("ord")).alias("o"), "rotation"))
    seen = yields.groupBy("doc_id").agg(F.coalesce(up, F.lit(0)).alias("up"), best.alias("b"))
    return seen.select("doc_id", F.when((F.col("up") < enough) & (F.col("b.chars") > F.greatest(F.lit(float(floor)), factor * F.col("up"))), F.col("b.rotation")).otherwise(0).alias("rotation"))
