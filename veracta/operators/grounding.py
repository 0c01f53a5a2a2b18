"""Boxes that a reader claims, checked against the words that stand in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import similarity
from ..functions.text import normal, substantial

VERIFY, CONTRADICT = 65, 50


def scale_box(box: Column, page_w: Column, page_h: Column) -> Column:
    """``[ymin, xmin, ymax, xmax]`` in thousandths to clamped pixels ``struct(x, y, w, h)``; null if it isn't four
    numbers, is a sliver, or covers most of the page."""
    ymin, xmin, ymax, xmax = (F.try_element_at(box, F.lit(i)) for i in (1, 2, 3, 4))
    low = lambda v, size: F.greatest(F.lit(0), F.least(size - 1, (v / 1000 * size).cast("int")))
    high = lambda v, size: F.greatest(F.lit(0), F.least(size, (v / 1000 * size).cast("int")))
    x1, y1 = low(xmin, page_w), low(ymin, page_h)
    w, h = high(xmax, page_w) - x1, high(ymax, page_h) - y1
    whole = (F.size(box) == 4) & ymin.isNotNull() & xmin.isNotNull() & ymax.isNotNull() & xmax.isNotNull()
    return F.when(whole & (w >= 30) & (h >= 12) & (w * h <= 0.65 * page_w * page_h), F.struct(x1.alias("x"), y1.alias("y"), w.alias("w"), h.alias("h")))


def words_in_boxes(words: DataFrame, boxes: DataFrame, row: int = 20) -> DataFrame:
    """``doc_id, region, text``: words whose centre is in a box, edges included, by rows of 20 pixels, then by x.

    An equi-join on the document with a range condition; a page has few boxes, so the work is one pass for each.
    """
    w = words.select("doc_id", "x", "y", "text", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    b = boxes.select("doc_id", "region", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.col("h").alias("bh"))
    inside = w.join(b, "doc_id").where("cx between bx and bx + bw and cy between by and by + bh")
    ordered = F.array_sort(F.collect_list(F.struct(F.floor(F.col("y") / row).alias("r"), F.col("x"), F.col("text"))))
    return inside.groupBy("doc_id", "region").agg(F.array_join(F.transform(ordered, lambda t: t["text"]), " ").alias("text"))


def audit(regions: DataFrame, claims: DataFrame, words: DataFrame, pages: DataFrame, prefix: str = "") -> DataFrame:
    """``doc_id, region, status, claimed, ocr, score, x, y, w, h, kept, verified`` for each of ``regions(doc_id, region, ord)``.

    ``claims(doc_id, region, box, text)`` are a reader's; ``prefix`` marks a second look (``refine_``). A box is dropped
    if it is implausible, or if enough words stand in it and say something else.
    """
    placed = regions.join(claims.withColumn("claimed_any", F.lit(True)), ["doc_id", "region"], "left").join(pages, "doc_id")
    placed = placed.withColumn("px", scale_box(F.col("box"), F.col("page_w"), F.col("page_h")))
    boxes = placed.where("px is not null").select("doc_id", "region", "px.*")
    seen = placed.join(words_in_boxes(words, boxes).withColumnRenamed("text", "ocr"), ["doc_id", "region"], "left").withColumn("ocr", F.coalesce("ocr", F.lit("")))
    claimed = F.coalesce("text", F.lit(""))
    # only what can be compared goes to the Arrow function
    both = F.col("px").isNotNull() & (claimed != "") & (F.col("ocr") != "")
    score = F.coalesce(similarity(F.when(both, normal(claimed)), F.when(both, normal(F.col("ocr"))), "cross_check"), F.lit(0.0))
    seen = seen.withColumn("score", score)
    against = substantial(F.col("ocr"), F.col("px.h")) & (claimed != "") & (F.col("score") < CONTRADICT)
    good = (claimed != "") & (F.col("ocr") != "") & (F.col("score") >= VERIFY)
    status = (
        F.when(F.col("claimed_any").isNull(), "missing_from_response").when(F.col("px").isNull(), "dropped_sanity").when(against, "dropped_contradicted").when(good, "verified").otherwise("unverified")
    )
    out = seen.select("doc_id", "region", "ord", status.alias("status"), claimed.alias("claimed"), F.left("ocr", F.lit(80)).alias("ocr"), F.round("score", 1).alias("score"), "px.*")
    kept = F.col("status").isin("verified", "unverified")
    out = out.withColumns({"kept": kept, "verified": F.col("status") == "verified"})
    return out.withColumn("status", F.concat(F.lit(prefix), "status")) if prefix else out


def strips(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, region, top, bottom``: the band of a page in which a region is expected, by its place among all, with room."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    rows = regions.join(pages, "doc_id").withColumns({"i": at, "strip": F.floor(F.col("page_h") / n).cast("int")})
    room = (F.col("strip") * 0.3).cast("int")
    return rows.select("doc_id", "region", F.greatest(F.lit(0), F.col("i") * F.col("strip") - room).alias("top"), F.least(F.col("page_h"), (F.col("i") + 1) * F.col("strip") + room).alias("bottom"))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Rows of each document's attempt with most kept boxes, the earliest on ties."""
    kept = attempts.groupBy("doc_id", "attempt").agg(F.count_if("kept").alias("n"))
    best = kept.groupBy("doc_id").agg(F.max_by("attempt", F.struct("n", -F.col("attempt"))).alias("attempt"))
    return attempts.join(best, ["doc_id", "attempt"], "left_semi")


def quorum(audited: DataFrame, share: float = 0.5, least_verified: int = 2) -> DataFrame:
    """``doc_id, requested, kept, verified, accepted``. Half a region rounds to even."""
    counts = audited.groupBy("doc_id").agg(F.countDistinct("region").alias("requested"), F.count_if("kept").alias("kept"), F.count_if("verified").alias("verified"))
    need = F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("requested")).cast("int"))
    return counts.withColumn("accepted", (F.col("kept") >= need) & (F.col("verified") >= least_verified))
