"""Reviewed records: corrections, exports, lists and job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import empty, squeeze

#: The task that a training sample states, with the field's name. Fixed value.
INSTRUCTION = "Transcris la valeur manuscrite du champ '%s' sur cet extrait d'acte de naissance gabonais. Réponds uniquement avec la valeur, sans commentaire."


def changes(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """The correction log's rows ``doc_id, field, crop, model_value, corrected_value, reviewer, ts``: fields whose new
    value differs; null and the empty string are the same. A field without an edit keeps its value."""
    both = fields.join(edits.select("doc_id", "field", F.col("value").alias("new"), "reviewer", "ts"), ["doc_id", "field"])
    changed = F.coalesce("new", F.lit("")) != F.coalesce("value", F.lit(""))
    return both.where(changed).select("doc_id", "field", "crop", F.col("value").alias("model_value"), F.col("new").alias("corrected_value"), "reviewer", "ts")


def overridden(fields: DataFrame, corrected: DataFrame, reports: DataFrame) -> DataFrame:
    """``doc_id, field, ord, value, status``: a corrected document's values are all the reviewer's, others' the model's."""
    done = corrected.select("doc_id").distinct().withColumn("done", F.lit(True))
    own = corrected.select("doc_id", "field", F.col("value").alias("fixed"))
    rows = fields.join(own, ["doc_id", "field"], "left").join(done, "doc_id", "left").join(reports.select("doc_id", "status"), "doc_id")
    return rows.select("doc_id", "field", "ord", F.when(F.col("done"), F.col("fixed")).otherwise(F.col("value")).alias("value"), F.when(F.col("done"), "corrected").otherwise(F.col("status")).alias("status"))


def column_order(fields: DataFrame) -> list[str]:
    """Field names in the order in which they first occur (document, then place). As many as schemas have."""
    first = fields.groupBy("field").agg(F.min(F.struct("doc_id", "ord")).alias("at"))
    return [r.field for r in first.orderBy("at", "field").collect()]


def wide(fields: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row for each document, a column for each field, empty where there is none."""
    names = column_order(fields) if names is None else names
    out = fields.groupBy("doc_id", "status").pivot("field", names).agg(F.first("value"))
    return out.na.fill("", names)


def sft(corrections: DataFrame) -> DataFrame:
    """``sample``: a chat as JSON for each correction with a crop and a value."""
    user = F.struct(F.lit("user").alias("role"), F.to_json(F.array(F.struct(F.lit("image").alias("type"), F.col("crop").alias("image"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), F.format_string(INSTRUCTION, "field").alias("text")))).alias("content"))
    quoted = lambda c: F.substring(F.to_json(F.struct(c.alias("v"))), 6, 1 << 30)  # noqa: E731  '"..."}'
    answer = F.concat(F.lit('{"role":"assistant","content":'), quoted(F.col("corrected_value")))
    rows = corrections.where(~empty(F.col("crop")) & ~empty(F.col("corrected_value")))
    return rows.select(F.concat(F.lit('{"messages":[{"role":"user","content":'), user["content"], F.lit("},"), answer, F.lit("]}")).alias("sample"))


def review_queue(scored: DataFrame) -> DataFrame:
    """A document's fields, least sure first."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("score", "ord")))


def counter(scored: DataFrame) -> DataFrame:
    return scored.groupBy("doc_id").agg(F.count_if("needs_review").alias("for_review"), F.count_if(~F.col("needs_review")).alias("accepted"))


def runs(reports: DataFrame, corrected: DataFrame, sent: DataFrame) -> DataFrame:
    """Runs, latest first, with whether they are reviewed and sent."""
    flag = lambda df, name: df.select("doc_id").distinct().withColumn(name, F.lit(True))
    out = reports.join(flag(corrected, "reviewed"), "doc_id", "left").join(flag(sent, "sent"), "doc_id", "left").na.fill(False, ["reviewed", "sent"])
    return out.orderBy(F.desc("modified"), "doc_id")


def corrections_quality(corrections: DataFrame) -> DataFrame:
    """Distinct corrections (field, model's value, corrected value), how many are wrong by more than white space, and
    in how many documents one occurs first. ``ord`` is the log's order."""
    key = [F.coalesce(F.col(c), F.lit("None")).alias(c) for c in ("field", "model_value", "corrected_value")]
    rows = corrections.select("doc_id", "ord", *key)
    # the least (document, place) of each key: an aggregation, so that a key that is corrected often isn't one task's
    first = rows.groupBy("field", "model_value", "corrected_value").agg(F.min(F.struct("doc_id", "ord")).alias("at"))
    wrong = squeeze(F.col("model_value")) != squeeze(F.col("corrected_value"))
    n, bad = F.count("*"), F.count_if(wrong)
    return first.agg(n.alias("reviewed"), bad.alias("wrong"), F.round(100 * bad / F.nullif(n, F.lit(0)), 1).alias("error_pct"), F.countDistinct("at.doc_id").alias("docs_touched"))


def job_status(log: DataFrame, jobs: DataFrame) -> DataFrame:
    """``job_id, status, stage`` from ``log(job_id, ord, line)`` and ``jobs(job_id, exit_code, report_ready, known)``.

    The stage is the last line that begins with ``[``, else the last line; of a failed job, its last three lines that
    aren't blank. A running job has no exit code.
    """
    filled = F.trim("line") != ""
    stage = F.coalesce(F.max_by(F.when(F.col("line").startswith("["), F.col("line")), F.when(F.col("line").startswith("["), F.col("ord"))), F.max_by(F.when(filled, F.col("line")), F.when(filled, F.col("ord"))), F.lit(""))
    # the third last place that counts, then the lines from there: no list of a whole log
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("ord")))
    tail = log.where(filled).withColumn("k", place).where("k <= 3").groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda t: t["line"]), " | ").alias("tail"))
    folded = log.groupBy("job_id").agg(stage.alias("stage")).join(tail, "job_id", "left")
    status = job_state(F.col("known"), F.col("exit_code"), F.col("report_ready"))
    out = jobs.join(folded, "job_id", "left").withColumn("status", status)
    return out.select("job_id", "status", F.when(F.col("status") == "error", F.coalesce("tail", F.lit(""))).otherwise(F.coalesce("stage", F.lit(""))).alias("stage"), "report_ready")


def job_state(known: Column, exit_code: Column, report_ready: Column) -> Column:
    return F.when(known & exit_code.isNull(), "running").when(report_ready, "done").when(known & (exit_code != 0), "error").when(known, "done_no_report").otherwise("unknown")


def upload_reason(name: Column, size: Column, most: int = 25 * 1024 * 1024) -> Column:
    """Why an upload is refused, or null."""
    ok = F.lower(name).rlike("\\.(png|jpe?g|tiff?|bmp|webp|pdf)$")
    return F.when(~F.coalesce(ok, F.lit(False)), "suffix").when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > most, "too large")


def work_list(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """``tier, id, status, started``: jobs at work or failed first, the latest started at the top, then runs by id."""
    open_ = jobs.where(F.col("status").isin("running", "error")).select(F.lit(0).alias("tier"), "id", "status", "started")
    rest = runs.select(F.lit(1).alias("tier"), "id", "status", F.lit(None).cast(jobs.schema["started"].dataType).alias("started"))
    return open_.unionByName(rest).orderBy("tier", F.desc("started"), "id")


def shown(correction: Column, value: Column) -> Column:
    """What a review shows: a correction even if it is empty, else the value, else nothing."""
    return F.coalesce(correction, value, F.lit(""))


def first_true(*values: Column) -> Column:
    """The first value that is neither null nor empty, else nothing."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def with_crop(regions: DataFrame, crops: DataFrame) -> DataFrame:
    """The regions whose crop is there."""
    return regions.join(crops.select("region"), "region", "left_semi")


def with_refined(first: DataFrame, refined: DataFrame) -> DataFrame:
    """Boxes of the first look and of the second, told apart by ``refined``."""
    return first.withColumn("refined", F.lit(False)).unionByName(refined.withColumn("refined", F.lit(True)))
