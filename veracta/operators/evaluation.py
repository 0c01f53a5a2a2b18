"""How good predictions are: against a reference, and against the system's own second reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.text import name_key, normal


def entries(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row for each (doc_id, field) of ``truth(doc_id, field, ref, ref_first, ref_last)``, joined with
    ``predicted(doc_id, field, pred, pred_first, pred_last)``; names are compared by their words in order of the alphabet."""
    rows = truth.join(predicted, ["doc_id", "field"], "left")
    is_name = F.col("field").endswith(".name")
    ref, pred = F.coalesce("ref", F.lit("")), F.coalesce("pred", F.lit(""))
    rows = rows.withColumns({"has_ref": F.trim(ref) != "", "has_pred": F.trim(pred) != "", "p": F.when(is_name, name_key(pred)).otherwise(pred), "r": F.when(is_name, name_key(ref)).otherwise(ref)})
    both, p, r = F.col("has_ref") & F.col("has_pred"), F.col("p"), F.col("r")
    valid = F.when(pred == "", True).when(F.col("field") == "child.dob", pred.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).when(F.col("field") == "child.gender", pred.isin("male", "female")).when(is_name, F.trim(pred) != "").otherwise(True)
    split = (normal(F.col("pred_first")) == normal(F.col("ref_first"))) & (normal(F.col("pred_last")) == normal(F.col("ref_last")))
    nls = F.when(both, M.nls(p, r)).otherwise(0.0)
    return rows.select(
        "doc_id", "field", "ref", "pred", "has_ref", "has_pred",
        F.when(both, M.anls(p, r)).otherwise(0.0).alias("anls"), nls.alias("nls"),
        F.when(F.col("has_ref"), M.cer(p, r)).alias("cer"), F.when(F.col("has_ref"), M.wer(p, r)).alias("wer"),
        (both & (normal(p) == normal(r))).alias("exact"), (both & (nls >= M.FUZZY)).alias("fuzzy"),
        F.when(is_name & both, split).alias("split_ok"), valid.alias("schema_ok"), (~F.col("has_ref") & F.col("has_pred")).alias("hallucinated"),
    )


def aggregate(rows: DataFrame) -> DataFrame:
    """The measures over all entries: ANLS over those with a reference, CER and WER over those answered."""
    answered = F.col("has_ref") & F.col("has_pred")
    expected, predicted = F.count_if("has_ref"), F.count_if("has_pred")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean = lambda c, where: zero(F.avg(F.when(where, F.col(c))))
    out = {"documents": F.countDistinct("doc_id"), "fields_expected": expected, "fields_predicted": predicted, "anls": mean("anls", F.col("has_ref")), "anls_answered": mean("anls", answered), "cer": mean("cer", answered), "wer": mean("wer", answered)}
    for kind in ("exact", "fuzzy"):
        p, r, f = M.prf(F.count_if(F.col("has_ref") & F.col(kind)), predicted, expected)
        out |= {f"{kind}_precision": zero(p), f"{kind}_recall": zero(r), f"{kind}_f1": zero(f)}
    out |= {
        "coverage": zero(F.try_divide(F.count_if(answered), F.nullif(expected, F.lit(0)))),
        "hallucination_rate": zero(F.try_divide(F.count_if("hallucinated"), F.nullif(F.count_if(~F.col("has_ref")), F.lit(0)))),
        "hallucination_slots": F.count_if(~F.col("has_ref")),
        "schema_conformance": zero(F.try_divide(F.count_if("schema_ok"), F.nullif(F.count("*"), F.lit(0)))),
        "name_split_accuracy": zero(F.avg(F.col("split_ok").cast("int"))),
    }
    return rows.agg(*(c.alias(k) for k, c in out.items()))


def places(rows: DataFrame) -> DataFrame:
    """Means over ``rows(pred, ref)`` of free text: ANLS, CER, ROUGE-L, BLEU of those with a reference."""
    p, r = F.coalesce("pred", F.lit("")), F.coalesce("ref", F.lit(""))
    return rows.where(r != "").agg(*(F.coalesce(F.avg(m(p, r)), F.lit(0.0)).alias(f"place_{m.__name__}") for m in (M.anls, M.cer, M.rouge_l, M.bleu)))


def per_field(rows: DataFrame) -> DataFrame:
    answered = F.col("has_ref") & F.col("has_pred")
    return rows.groupBy("field").agg(
        F.count_if("has_ref").alias("n"), F.count_if("exact").alias("exact"), F.count_if("fuzzy").alias("fuzzy"), F.coalesce(F.avg(F.when(F.col("has_ref"), F.col("anls"))), F.lit(0.0)).alias("anls"),
        F.coalesce(F.avg(F.when(answered, F.col("cer"))), F.lit(0.0)).alias("cer"), F.coalesce(F.try_divide(F.count_if(answered), F.nullif(F.count_if("has_ref"), F.lit(0))), F.lit(0.0)).alias("coverage"),
    )


def per_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(F.col("has_ref"), F.col("anls"))), F.lit(0.0)).alias("anls"), F.count_if("exact").alias("exact"), F.count_if("has_ref").alias("expected"))


def errors(rows: DataFrame) -> DataFrame:
    """Fields that are wrong or missing."""
    return rows.where("has_ref and not exact").select("doc_id", "field", "ref", "pred")


def swapped(rows: DataFrame) -> DataFrame:
    """Names that read the same but whose parts are in the wrong slots."""
    return rows.where("exact and split_ok = false").select("doc_id", "field", "ref", "pred")


def batch_rows(scored: DataFrame) -> DataFrame:
    """For each document: totals, the share accepted, its bands, and acceptance against agreement of the two readings."""
    sure, agree = ~F.col("needs_review"), F.col("agreement")
    n, auto = F.count("*"), F.count_if(sure)
    return scored.groupBy("doc_id").agg(
        n.alias("fields_total"), auto.alias("fields_auto_accepted"), F.round(100 * auto / n, 1).alias("pct_auto_accepted"),
        *(F.count_if(F.col("band") == b).alias(f"band_{b}") for b in ("high", "medium", "low")),
        F.count_if(sure & agree).alias("tp"), F.count_if(sure & ~agree).alias("fp"), F.count_if(~sure & agree).alias("fn"), F.count_if(~sure & ~agree).alias("tn"),
    )


def confusion(rows: DataFrame) -> DataFrame:
    """Sums of the documents' counts, and precision, recall, F1 and accuracy; null where a denominator is 0."""
    sums = rows.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn", "tn")))
    p, r, f = M.prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    n = F.expr("tp + fp + fn + tn")
    return sums.select(n.alias("n"), "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), f.alias("f1"), F.try_divide(F.col("tp") + F.col("tn"), F.nullif(n, F.lit(0))).alias("accuracy"))


def yields(rows: DataFrame) -> DataFrame:
    """The mean of documents' rounded shares, and the share of all fields together."""
    return rows.agg(F.count("*").alias("documents"), F.avg("fields_total").alias("mean_fields"), F.avg("pct_auto_accepted").alias("macro_pct"), (100 * F.sum("fields_auto_accepted") / F.nullif(F.sum("fields_total"), F.lit(0))).alias("micro_pct"), *(F.sum(f"band_{b}").alias(f"band_{b}") for b in ("high", "medium", "low")))
