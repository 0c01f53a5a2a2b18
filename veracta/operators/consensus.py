"""Two readings of every field merged into one, scored, and reported for each document.

Rows are long: one for each document and field. Joins are on (doc_id, field)
and left joins keep the declared fields, so both sides shuffle on the same key
and the report's aggregation only needs doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import ratio_column, similarity
from ..functions.text import empty, normal_value

AGREE, HIGH, LOW, BATCH = 90, 0.85, 0.60, 5
#: Strings up to this length are compared in Catalyst, longer ones by an Arrow function.
SHORT = 24


def agreement(a: Column, b: Column, arrow: bool = True) -> Column:
    """Whether two readings say the same; null if either says nothing."""
    x, y = normal_value(a), normal_value(b)
    score = similarity(x, y) if arrow else ratio_column(x, y)
    return F.when(~empty(a) & ~empty(b), F.when(x == y, True).otherwise(score >= AGREE))


def batches(fields: DataFrame, size: int = BATCH) -> DataFrame:
    """``batch``: which call reads a field, ``size`` of a document's fields by ``ord`` to each."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return fields.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def last_write(observations: DataFrame) -> DataFrame:
    """One observation for each (doc_id, field) of rows with ``batch`` and ``error``: the last one that was read;
    an error's stub only where there is none, and then the first."""
    ok, row = F.col("error").isNull(), F.struct("raw", "value", "confidence", "error", "batch")
    best = F.coalesce(F.max_by(F.when(ok, row), F.when(ok, F.col("batch"))), F.min_by(F.when(~ok, row), F.when(~ok, F.col("batch"))))
    return observations.groupBy("doc_id", "field").agg(best.alias("o")).select("doc_id", "field", "o.*")


def merge(fields: DataFrame, page: DataFrame, crop: DataFrame, boxes: DataFrame | None = None, crops_read: bool = True, skip_stubs: bool = False, arrow: bool = True) -> DataFrame:
    """The merged record of ``fields(doc_id, ord, field, type, region)``.

    ``page`` and ``crop`` are ``(doc_id, field, raw, value, confidence)``, ``crop`` perhaps with ``error``; ``boxes`` is
    ``(doc_id, region, bbox, crop_path, interpolated)``. A crop's value counts where there is one, or where neither has
    one; confidence is the mean of both readings. A failed crop call's stub has confidence 0 and halves that mean, as the
    system described does; ``skip_stubs`` leaves it out.
    """
    side = lambda df, p, *more: df.select("doc_id", "field", *(F.col(c).alias(f"{p}_{c}") for c in ("raw", "value", "confidence", *more)))
    more = ["error"] if "error" in crop.columns else []
    out = fields.join(side(page, "page"), ["doc_id", "field"], "left").join(side(crop, "crop", *more), ["doc_id", "field"], "left")
    if boxes is not None:
        out = out.join(boxes, ["doc_id", "region"], "left")
    else:
        out = out.withColumns({"bbox": F.lit(None).cast("array<int>"), "crop_path": F.lit(None).cast("string"), "interpolated": F.lit(None).cast("boolean")})
    has_crop = (F.coalesce(F.col("region"), F.lit("page")) != "page") & F.col("crop_confidence").isNotNull()
    if skip_stubs and more:
        has_crop = has_crop & F.col("crop_error").isNull()
    use_crop = has_crop & (F.col("crop_value").isNotNull() | F.col("page_value").isNull())
    page_conf = F.coalesce("page_confidence", F.lit(0.0))
    conf = F.when(has_crop, (page_conf + F.coalesce("crop_confidence", F.lit(0.0))) / 2).otherwise(page_conf)
    return out.select(
        "doc_id", "ord", "field", "type", "region",
        F.when(use_crop, F.col("crop_value")).otherwise(F.col("page_value")).alias("value"),
        F.coalesce(F.when(use_crop, F.col("crop_raw")).otherwise(F.col("page_raw")), F.lit("")).alias("raw"),
        F.when(use_crop, "crop").otherwise("page").alias("source"),
        "page_value", F.when(has_crop, F.col("crop_value")).alias("crop_value"),
        F.round(conf, 3).alias("model_confidence"),
        F.when(has_crop, agreement(F.col("page_value"), F.col("crop_value"), arrow)).alias("agreement"),
        "bbox", F.col("crop_path").alias("crop"),
        (F.col("interpolated") if crops_read else F.lit(True)).alias("anchor_interpolated"),
    )


def raw_score(conf: Column, agree: Column, interpolated: Column, value: Column, has_ok: Column, has_warn: Column, has_fail: Column) -> Column:
    """The score before rounding, in doubles: what is on an edge of a band must fall as it does there."""
    checks = F.when(has_fail, 0.0).when(has_ok & ~has_warn, 1.0).otherwise(0.5)
    s = 0.50 * F.coalesce(conf, F.lit(0.0)) + 0.30 * F.when(agree.isNull(), 0.5).when(agree, 1.0).otherwise(0.0) + 0.20 * checks
    s = F.when(F.coalesce(interpolated, F.lit(False)), s - 0.08).otherwise(s)
    s = F.when(has_warn, s - 0.15).otherwise(s)
    s = F.when(has_fail, F.least(s, F.lit(0.40))).otherwise(s)
    s = F.when(empty(value), F.least(s, F.lit(0.30))).otherwise(s)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def band(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= LOW, "medium").otherwise("low")


def score(merged: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """``merged`` with ``findings`` nested, ``score`` (rounded), ``raw_score``, ``band`` and ``needs_review``. Bands are by the raw score."""
    if findings is None:
        nested = merged.withColumn("findings", F.array().cast("array<struct<field:string,level:string,message:string>>"))
    else:
        own = findings.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.struct("ord", "field", "level", "message"))).alias("fs"))
        own = own.withColumn("findings", F.transform("fs", lambda f: F.struct(f["field"].alias("field"), f["level"].alias("level"), f["message"].alias("message")))).drop("fs")
        nested = merged.join(own, ["doc_id", "field"], "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<field:string,level:string,message:string>>")))
    has = {level: F.array_contains(F.col("findings.level"), F.lit(level)) for level in ("ok", "warn", "fail")}
    s = raw_score(F.col("model_confidence"), F.col("agreement"), F.col("anchor_interpolated"), F.col("value"), has["ok"], has["warn"], has["fail"])
    out = nested.withColumn("raw_score", s)
    return out.withColumns({"score": F.round("raw_score", 3), "band": band(F.col("raw_score")), "needs_review": F.col("raw_score") < HIGH})


def report(scored: DataFrame) -> DataFrame:
    """One row for each document: totals, the fields for review in order, and its status."""
    n, auto = F.count("*"), F.count_if(~F.col("needs_review"))
    listed = F.array_sort(F.collect_list(F.when(F.col("needs_review"), F.struct("ord", "field"))))
    return scored.groupBy("doc_id").agg(
        n.alias("fields_total"), auto.alias("fields_auto_accepted"), F.transform(listed, lambda x: x["field"]).alias("fields_for_review"),
        F.when(n == auto, "auto_accepted").otherwise("needs_review").alias("status"),
    )
