"""The queries that are registered for the driver: every operator over the driver's tables, with SQL that says the same.

Each projects a table into the shape of a record first, by the same expression on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, fuzzy, json_repair, metrics, text
from ..operators import consensus, evaluation, grounding, layout, mapping, review
from ..streaming import states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- two readings of every field: an order is a document, its lines are fields -------------------------------------

_BASE = """base AS (
  SELECT l_orderkey AS doc_id, concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS field, l_linenumber AS ord,
    max(l_returnflag) AS rf, max(l_linestatus) AS ls, max(l_discount) * 10 AS pc, max(l_tax) * 10 AS cc, CAST(max(l_quantity) AS INT) AS q, max(l_extendedprice) AS ep
  FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber)"""

_SCORED = (
    "WITH "
    + _BASE
    + """, r AS (
  SELECT *, CASE WHEN q % 11 = 0 THEN NULL ELSE rf || '-' || ls || CAST(ord AS VARCHAR) END AS pv,
    CASE WHEN q % 4 = 0 THEN NULL WHEN q % 5 = 0 THEN 'zz' || ls || CAST(ord AS VARCHAR) ELSE lower(rf) || ' ' || ls || CAST(ord AS VARCHAR) END AS cv,
    ord NOT IN (5, 6) AS crop, CASE WHEN ord = 7 THEN NULL ELSE (doc_id + ord) % 3 = 0 END AS interp,
    ep > 90000 AS has_fail, q < 5 AS has_warn, q BETWEEN 20 AND 30 AS has_ok FROM base),
m AS (
  SELECT *, CASE WHEN crop AND (cv IS NOT NULL OR pv IS NULL) THEN cv ELSE pv END AS v,
    CASE WHEN crop THEN (pc + cc) / 2 ELSE pc END AS conf0,
    CASE WHEN crop AND pv IS NOT NULL AND cv IS NOT NULL THEN replace(lower(pv), '-', ' ') = lower(cv) END AS agree FROM r),
n AS (SELECT *, round(conf0, 3) AS conf FROM m),
s0 AS (
  SELECT *, 0.50 * conf + 0.30 * CASE WHEN agree IS NULL THEN 0.5 WHEN agree THEN 1.0 ELSE 0.0 END
    + 0.20 * CASE WHEN has_fail THEN 0.0 WHEN has_ok AND NOT has_warn THEN 1.0 ELSE 0.5 END AS a FROM n),
s1 AS (SELECT *, CASE WHEN coalesce(interp, false) THEN a - 0.08 ELSE a END AS b FROM s0),
s2 AS (SELECT *, CASE WHEN has_warn THEN b - 0.15 ELSE b END AS c FROM s1),
s3 AS (SELECT *, CASE WHEN has_fail THEN least(c, 0.40) ELSE c END AS d FROM s2),
s4 AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN coalesce(v, '') = '' THEN least(d, 0.30) ELSE d END)) AS raw_score FROM s3),
scored AS (
  SELECT doc_id, field, ord, v AS value, conf AS model_confidence, agree AS agreement, round(raw_score, 3) AS score,
    CASE WHEN raw_score >= 0.85 THEN 'high' WHEN raw_score >= 0.60 THEN 'medium' ELSE 'low' END AS band, raw_score < 0.85 AS needs_review FROM s4)"""
).replace("0.50 *", "CAST(0.50 AS DOUBLE) *").replace("0.30 * CASE", "CAST(0.30 AS DOUBLE) * CASE").replace("0.20 * CASE", "CAST(0.20 AS DOUBLE) * CASE")

_BATCH = (
    _SCORED
    + """, docs AS (
  SELECT doc_id, count(*) AS fields_total, count(*) FILTER (NOT needs_review) AS fields_auto_accepted,
    round(100 * CAST(count(*) FILTER (NOT needs_review) AS DOUBLE) / count(*), 1) AS pct_auto_accepted,
    count(*) FILTER (band = 'high') AS band_high, count(*) FILTER (band = 'medium') AS band_medium, count(*) FILTER (band = 'low') AS band_low,
    count(*) FILTER (NOT needs_review AND agreement) AS tp, count(*) FILTER (NOT needs_review AND NOT agreement) AS fp,
    count(*) FILTER (needs_review AND agreement) AS fn, count(*) FILTER (needs_review AND NOT agreement) AS tn FROM scored GROUP BY doc_id)"""
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").agg(
        F.max("l_returnflag").alias("rf"), F.max("l_linestatus").alias("ls"), (F.max("l_discount") * 10).alias("pc"), (F.max("l_tax") * 10).alias("cc"),
        F.max("l_quantity").cast("int").alias("q"), F.max("l_extendedprice").alias("ep"),
    )
    ord_ = F.col("l_linenumber")
    base = base.select("*", F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("field"), ord_.alias("ord"), F.when(ord_ == 6, "page").otherwise(F.concat(F.lit("r"), ord_)).alias("region"))
    pv = F.when(F.col("q") % 11 != 0, F.concat("rf", F.lit("-"), "ls", "ord"))
    cv = F.when(F.col("q") % 4 == 0, None).when(F.col("q") % 5 == 0, F.concat(F.lit("zz"), "ls", "ord")).otherwise(F.concat(F.lower("rf"), F.lit(" "), "ls", "ord"))
    # both readings come from one row, so the merge's inputs are one projection and not a join with themselves
    has_crop = ~F.col("ord").isin(5, 6)
    use_crop = has_crop & (cv.isNotNull() | pv.isNull())
    conf = F.round(F.when(has_crop, (F.col("pc") + F.col("cc")) / 2).otherwise(F.col("pc")), 3)
    merged = base.select(
        "doc_id", "field", "ord", F.when(use_crop, cv).otherwise(pv).alias("value"), conf.alias("model_confidence"), F.when(has_crop, consensus.agreement(pv, cv, arrow=False)).alias("agreement"),
        F.when(F.col("ord") != 7, (F.col("doc_id") + F.col("ord")) % 3 == 0).alias("anchor_interpolated"), (F.col("q").between(20, 30)).alias("has_ok"), (F.col("q") < 5).alias("has_warn"), (F.col("ep") > 90000).alias("has_fail"),
    )
    raw = consensus.raw_score(F.col("model_confidence"), F.col("agreement"), F.col("anchor_interpolated"), F.col("value"), F.col("has_ok"), F.col("has_warn"), F.col("has_fail"))
    out = merged.withColumn("raw_score", raw)
    return out.withColumns({"score": F.round("raw_score", 3), "band": consensus.band(F.col("raw_score")), "needs_review": F.col("raw_score") < consensus.HIGH})


@query(_SCORED + " SELECT doc_id, count(*) AS fields_total, count(*) FILTER (NOT needs_review) AS fields_auto_accepted, coalesce(string_agg(field, ',' ORDER BY ord, field) FILTER (needs_review), '') AS fields_for_review, CASE WHEN bool_or(needs_review) THEN 'needs_review' ELSE 'auto_accepted' END AS status FROM scored GROUP BY doc_id")
def consensus_report(spark, sf_dir):
    return consensus.report(scored(spark, sf_dir)).withColumn("fields_for_review", F.array_join("fields_for_review", ","))


@query(_SCORED + " SELECT doc_id, field, value, model_confidence, agreement, score, band, needs_review FROM scored")
def field_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "field", "value", "model_confidence", "agreement", "score", "band", "needs_review")


@query(
    "WITH "
    + _BASE
    + """, f AS (SELECT doc_id, field, ord, rf || '-' || ls AS pv, CASE WHEN q % 4 = 0 THEN NULL ELSE lower(rf) || ' ' || ls END AS cv, pc, cc, q % 7 <> 0 AS has_page, ord <> 5 AS crop FROM base)
SELECT doc_id, field, CASE WHEN crop AND (cv IS NOT NULL OR NOT has_page) THEN cv WHEN has_page THEN pv END AS value, CASE WHEN crop AND (cv IS NOT NULL OR NOT has_page) THEN 'crop' ELSE 'page' END AS source,
  round(CASE WHEN crop THEN (CASE WHEN has_page THEN pc ELSE 0 END + cc) / 2 WHEN has_page THEN pc ELSE 0 END, 3) AS model_confidence, CASE WHEN crop AND has_page AND cv IS NOT NULL THEN true END AS agreement FROM f"""
)
def two_pass_merge(spark, sf_dir):
    """The merge as three joins, where the readings are tables of their own."""
    base = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").agg(F.max("l_returnflag").alias("rf"), F.max("l_linestatus").alias("ls"), (F.max("l_discount") * 10).alias("pc"), (F.max("l_tax") * 10).alias("cc"), F.max("l_quantity").cast("int").alias("q"))
    base = base.select("*", F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("field"), F.col("l_linenumber").alias("ord"))
    fields = base.select("doc_id", "ord", "field", F.lit("text").alias("type"), F.concat(F.lit("r"), "ord").alias("region"))
    pv = F.concat("rf", F.lit("-"), "ls")
    page = base.where("q % 7 <> 0").select("doc_id", "field", pv.alias("raw"), pv.alias("value"), F.col("pc").alias("confidence"))
    cv = F.when(F.col("q") % 4 != 0, F.concat(F.lower("rf"), F.lit(" "), "ls"))
    crop = base.where("ord <> 5").select("doc_id", "field", cv.alias("raw"), cv.alias("value"), F.col("cc").alias("confidence"))
    return consensus.merge(fields, page, crop, arrow=False).select("doc_id", "field", "value", "source", "model_confidence", "agreement")


@query(_BATCH + " SELECT doc_id, band_high, band_medium, band_low FROM docs")
def band_histogram(spark, sf_dir):
    return evaluation.batch_rows(scored(spark, sf_dir)).select("doc_id", "band_high", "band_medium", "band_low")


@query(_BATCH + " SELECT * FROM docs")
def batch_metrics(spark, sf_dir):
    return evaluation.batch_rows(scored(spark, sf_dir))


@query(
    _BATCH
    + """, t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn FROM docs),
u AS (SELECT *, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS p, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS r FROM t)
SELECT tp + fp + fn + tn AS n, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1, round((tp + tn) / nullif(CAST(tp + fp + fn + tn AS DOUBLE), 0), 6) AS accuracy FROM u"""
)
def confusion_prf(spark, sf_dir):
    out = evaluation.confusion(evaluation.batch_rows(scored(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "accuracy")})


@query(
    _BATCH
    + """ SELECT count(*) AS documents, round(avg(fields_total), 6) AS mean_fields, round(avg(pct_auto_accepted), 4) AS macro_pct, round(100 * CAST(sum(fields_auto_accepted) AS DOUBLE) / sum(fields_total), 6) AS micro_pct,
  CAST(sum(band_high) AS BIGINT) AS band_high, CAST(sum(band_medium) AS BIGINT) AS band_medium, CAST(sum(band_low) AS BIGINT) AS band_low FROM docs"""
)
def macro_vs_micro(spark, sf_dir):
    out = evaluation.yields(evaluation.batch_rows(scored(spark, sf_dir)))
    return out.withColumns({"mean_fields": F.round("mean_fields", 6), "macro_pct": F.round("macro_pct", 4), "micro_pct": F.round("micro_pct", 6)})


@query(_SCORED + " SELECT doc_id, field, score, row_number() OVER (PARTITION BY doc_id ORDER BY score, ord, field) AS place FROM scored")
def review_queue(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("ord", F.struct("ord", "field"))
    return review.review_queue(rows).select("doc_id", "field", "score", F.col("place").cast("long").alias("place"))


@query(_SCORED + " SELECT doc_id, count(*) FILTER (needs_review) AS for_review, count(*) FILTER (NOT needs_review) AS accepted FROM scored GROUP BY doc_id")
def review_counter(spark, sf_dir):
    return review.counter(scored(spark, sf_dir))


# --- exports and reviewed records ------------------------------------------------------------------------------------


@query(
    "SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, 'exported' AS status, "
    + ", ".join(f"coalesce(max(CASE WHEN l_linenumber = {i} THEN l_returnflag || l_linestatus END), '') AS field_{i}" for i in range(1, 8))
    + " FROM lineitem GROUP BY l_orderkey"
)
def wide_export(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("value"))
    rows = rows.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("exported").alias("status"), F.concat(F.lit("field_"), "l_linenumber").alias("field"), F.col("l_linenumber").alias("ord"), "value")
    # the fields of the schema; what a table holds is found by review.column_order
    return review.wide(rows, [f"field_{i}" for i in range(1, 8)])


@query("SELECT field, row_number() OVER (ORDER BY d, o, field) AS place FROM (SELECT 'field_' || CAST(l_linenumber AS VARCHAR) AS field, arg_min(l_orderkey, l_orderkey) AS d, min(l_linenumber) AS o FROM lineitem GROUP BY l_linenumber)")
def export_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("field_"), "l_linenumber").alias("field"), F.col("l_linenumber").alias("ord"))
    names = review.column_order(rows)
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "field string, place long")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 1 THEN 'good' ELSE NULL END ELSE d.source END AS value, CASE WHEN l.doc_id IS NOT NULL THEN 'corrected' ELSE 'needs_review' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def override_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fields = docs.select("doc_id", F.lit("source").alias("field"), F.lit(0).alias("ord"), F.col("source").alias("value"))
    fixed = labels.select("doc_id", F.lit("source").alias("field"), F.when(F.col("quality") == 1, "good").alias("value"))
    return review.overridden(fields, fixed, docs.select("doc_id", F.lit("needs_review").alias("status"))).select("doc_id", "value", "status")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT d.doc_id, d.lang, l.doc_id IS NOT NULL AS reviewed, coalesce(l.toxic, 0) = 1 AS sent FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IN ('en', 'fr')")
def doc_flags(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr")), table(spark, sf_dir, "labels")
    return review.runs(docs.select("doc_id", "lang", F.lit(0).alias("modified")), labels, labels.where("toxic = 1")).select("doc_id", "lang", "reviewed", "sent")


_EDITS = "WITH e AS (SELECT conv_id AS doc_id, CAST(turn AS VARCHAR) AS field, text AS corrected_value, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS model_value, turn FROM conversations)"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("field"), F.col("text").alias("new"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("value"), "turn")


@query(_EDITS + " SELECT doc_id, field, model_value, corrected_value FROM e WHERE coalesce(model_value, '') <> coalesce(corrected_value, '')")
def cdc_diff(spark, sf_dir):
    rows = _edits(spark, sf_dir)
    fields = rows.select("doc_id", "field", F.lit(None).cast("string").alias("crop"), "value")
    edits = rows.select("doc_id", "field", F.col("new").alias("value"), F.lit("r").alias("reviewer"), F.lit(0).alias("ts"))
    return review.changes(fields, edits).select("doc_id", "field", "model_value", "corrected_value")


_WHITE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_WRONG = f"{_WHITE.format('m')} <> {_WHITE.format('c')}"


@query(
    _EDITS.replace("CAST(turn AS VARCHAR) AS field", "CAST(turn % 3 AS VARCHAR) AS field")
    + f""", k AS (SELECT field, coalesce(model_value, 'None') AS m, coalesce(corrected_value, 'None') AS c, min(struct_pack(d := doc_id, o := turn)) AS place FROM e GROUP BY ALL)
SELECT count(*) AS reviewed, count(*) FILTER ({_WRONG}) AS wrong, round(100 * CAST(count(*) FILTER ({_WRONG}) AS DOUBLE) / count(*), 1) AS error_pct, count(DISTINCT place.d) AS docs_touched FROM k"""
)
def dedupe_corrections(spark, sf_dir):
    """Whole values, as the log has them."""
    return review.corrections_quality(_corrections(_edits(spark, sf_dir)))


def _corrections(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("turn").alias("ord"), (F.col("turn") % 3).cast("string").alias("field"), F.col("value").alias("model_value"), F.col("new").alias("corrected_value"))


@query("SELECT doc_id, field, n_messages, answer FROM (SELECT conv_id AS doc_id, CAST(turn AS VARCHAR) AS field, 2 AS n_messages, lead(text) OVER w AS answer, role, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant' AND coalesce(answer, '') <> ''")
def sft_export(spark, sf_dir):
    """Samples as JSON, read back: what a training job would get of them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next"), F.lead("text").over(w).alias("answer"))
    pairs = rows.where("role = 'user' and next = 'assistant'").select(F.concat_ws("/", "conv_id", "turn").alias("crop"), F.lit("f").alias("field"), F.col("answer").alias("corrected_value"))
    parsed = review.sft(pairs).select(F.from_json("sample", "struct<messages:array<struct<role:string,content:string>>>")["messages"].alias("m"))
    image = F.get_json_object(F.col("m")[0]["content"], "$[0].image")
    return parsed.select(F.split(image, "/")[0].cast("long").alias("doc_id"), F.split(image, "/")[1].alias("field"), F.size("m").alias("n_messages"), F.col("m")[1]["content"].alias("answer"))


# --- text, names, mappings --------------------------------------------------------------------------------------------

_PACKS = (("aa", 1, ("the", "with")), ("bb", 2, ("nicht", "The")), ("cc", 3, ("que", "éau")), ("dd", 4, ("cion", "ÑO")))


@query(
    f"WITH p(country, ord, k) AS (VALUES {', '.join(f'({c!r}, {o}, {k!r})' for c, o, ks in _PACKS for k in ks)}), "
    + "d AS (SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents), "
    + "h AS (SELECT doc_id, country, ord, count(*) FILTER (contains(t, lower(strip_accents(k)))) AS hits FROM d, p GROUP BY ALL), "
    + "b AS (SELECT doc_id, arg_max(country, hits * 100 - ord) AS country, max(hits) AS hits FROM h GROUP BY doc_id) SELECT doc_id, CASE WHEN hits > 0 THEN country ELSE 'zz' END AS country, hits FROM b"
)
def country_detect(spark, sf_dir):
    packs = spark.createDataFrame([(c, o, list(k)) for c, o, k in _PACKS], "country string, ord int, keywords array<string>")
    return layout.detect_country(table(spark, sf_dir, "documents"), packs).withColumn("hits", F.col("hits").cast("long"))


_PAIRS = "WITH n AS (SELECT p_partkey, p_name AS pred, lead(p_name) OVER (ORDER BY p_partkey) AS ref FROM part), q AS (SELECT p_partkey, lower(pred) AS p, lower(coalesce(ref, '')) AS r FROM n)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name beside the next part's: joined on the key, so that no window has all rows in one task."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("pred"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("pred").alias("ref"))
    return part.join(after, "p_partkey", "left")


@query(
    _PAIRS
    + """, m AS (SELECT *, levenshtein(p, r) AS lev, CASE WHEN p = '' AND r = '' THEN 1.0 WHEN p = '' OR r = '' THEN 0.0 ELSE 1.0 - CAST(levenshtein(p, r) AS DOUBLE) / greatest(length(p), length(r)) END AS nls FROM q)
SELECT p_partkey, lev, round(nls, 6) AS nls, round(CASE WHEN nls >= 0.5 THEN nls ELSE 0 END, 6) AS anls, round(CASE WHEN r <> '' THEN CAST(lev AS DOUBLE) / length(r) WHEN p = '' THEN 0 ELSE 1 END, 6) AS cer FROM m"""
)
def lev_metrics(spark, sf_dir):
    p, r = F.col("pred"), F.col("ref")
    return _pairs(spark, sf_dir).select("p_partkey", F.levenshtein(text.normal(p), text.normal(r)).cast("long").alias("lev"), *(F.round(m(p, r), 6).alias(m.__name__) for m in (metrics.nls, metrics.anls, metrics.cer)))


@query(
    "WITH RECURSIVE n AS (SELECT p_partkey, p_name AS a, coalesce(lead(p_name) OVER (ORDER BY p_partkey), '') AS b FROM part), "
    + "w AS (SELECT p_partkey, a, b, 0 AS i, list_resize([0], length(b) + 1, 0) AS row FROM n UNION ALL "
    + "SELECT p_partkey, a, b, i + 1, list_reduce(list_concat([[0]], list_transform(range(1, length(b) + 1), lambda j: [CASE WHEN b[j] = a[i + 1] THEN row[j] + 1 ELSE -1 END, row[j + 1]])), "
    + "lambda acc, x: list_append(acc, CASE WHEN x[1] >= 0 THEN x[1] ELSE greatest(x[2], acc[-1]) END)) FROM w WHERE i < length(a)) "
    + "SELECT p_partkey, CAST(row[-1] AS BIGINT) AS lcs, round(200.0 * row[-1] / (length(a) + length(b)), 6) AS ratio FROM w WHERE i = length(a)"
)
def lcs_ratio(spark, sf_dir):
    a, b = F.col("pred"), F.coalesce("ref", F.lit(""))
    both = _pairs(spark, sf_dir).withColumn("ratio", fuzzy.similarity(a, b))
    return both.select("p_partkey", F.round(F.col("ratio") * (F.char_length(a) + F.char_length(b)) / 200).cast("long").alias("lcs"), F.round("ratio", 6).alias("ratio"))


@query()
def wer_rouge_bleu(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ref"))
    after = bench.select((F.col("item_id") - 1).alias("item_id"), F.col("ref").alias("pred"))
    p, r = F.col("pred"), F.col("ref")
    return bench.join(after, "item_id", "left").select("item_id", *(F.round(m(p, r), 6).alias(m.__name__) for m in (metrics.wer, metrics.rouge_l, metrics.bleu)))


_NAMES = "WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN replace(c_name, '#', ' ') WHEN 1 THEN upper(split_part(c_name, '#', 1)) || ' jean ' || split_part(c_name, '#', 2) WHEN 2 THEN upper(split_part(c_name, '#', 1)) ELSE 'Ana, Maria' END AS f FROM customer)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, k = F.col("c_name"), F.col("c_custkey") % 4
    first, second = F.split_part(name, F.lit("#"), F.lit(1)), F.split_part(name, F.lit("#"), F.lit(2))
    full = F.when(k == 0, F.replace(name, F.lit("#"), F.lit(" "))).when(k == 1, F.concat(F.upper(first), F.lit(" jean "), second)).when(k == 2, F.upper(first)).otherwise("Ana, Maria")
    return table(spark, sf_dir, "customer").select("c_custkey", full.alias("f"))


@query(
    _NAMES
    + """, t AS (SELECT c_custkey, regexp_split_to_array(trim(regexp_replace(replace(f, ',', ' '), '\\s+', ' ', 'g')), ' ') AS tok FROM n),
u AS (SELECT c_custkey, tok, list_filter(tok, lambda x: length(x) >= 2 AND x = upper(x) AND regexp_matches(x, '[A-Z]')) AS up, list_filter(tok, lambda x: NOT (length(x) >= 2 AND x = upper(x) AND regexp_matches(x, '[A-Z]'))) AS low FROM t)
SELECT c_custkey, CASE WHEN len(up) > 0 AND len(low) > 0 THEN array_to_string(low, ' ') WHEN len(tok) = 1 THEN CASE WHEN len(up) = 1 THEN '' ELSE tok[1] END ELSE array_to_string(tok[:-2], ' ') END AS firstname,
  CASE WHEN len(up) > 0 AND len(low) > 0 THEN array_to_string(up, ' ') WHEN len(tok) = 1 THEN CASE WHEN len(up) = 1 THEN tok[1] ELSE '' END ELSE tok[-1] END AS surname FROM u""".replace("\\\\", "\\")
)
def name_split(spark, sf_dir):
    return _names(spark, sf_dir).select("c_custkey", text.split_name(F.col("f")).alias("n")).select("c_custkey", "n.*")


@query(_NAMES + r" SELECT c_custkey, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(f), '\s+'), lambda x: x <> '')), ' ') AS name_key FROM n")
def name_key(spark, sf_dir):
    return _names(spark, sf_dir).select("c_custkey", text.name_key(F.col("f")).alias("name_key"))


_GENDERS = ("Masculin", " f ", "FÉMININ", "Garçon", "fille", "M", "inconnu", "male")
_RELATIONS = ("Père", "la mère du père", "Grand-père", "MÈRE", "oncle", "Sa mère")
_NATIONS = ("TUNISIENNE", "Citoyen Français de Naissance", "Somalienne", "sénégalaise", "CONGOLAIS", "Nigérienne", "Burkinabè", "de nationalité malienne")


def _values(words: tuple[str, ...]) -> str:
    return ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))


def _by_nation(spark: SparkSession, sf_dir: str, words: tuple[str, ...]) -> DataFrame:
    v = F.element_at(F.array(*(F.lit(w) for w in words)), (F.col("n_nationkey") % len(words) + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), v.alias("v"))


def _nation_sql(words: tuple[str, ...], expr: str) -> str:
    return f"WITH w(i, v) AS (VALUES {_values(words)}) SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, v, {expr} FROM nation JOIN w ON i = n_nationkey % {len(words)}"


@query(_nation_sql(_GENDERS, "CASE WHEN lower(trim(strip_accents(v))) IN ('masculin', 'm', 'male', 'garcon') THEN 'male' WHEN lower(trim(strip_accents(v))) IN ('feminin', 'f', 'female', 'fille') THEN 'female' END AS gender"))
def gender_map(spark, sf_dir):
    return _by_nation(spark, sf_dir, _GENDERS).withColumn("gender", text.gender(F.col("v")))


@query(_nation_sql(_RELATIONS, "CASE WHEN contains(lower(strip_accents(v)), 'pere') THEN 'FATHER' WHEN contains(lower(strip_accents(v)), 'mere') THEN 'MOTHER' END AS relation"))
def relation_map(spark, sf_dir):
    return _by_nation(spark, sf_dir, _RELATIONS).withColumn("relation", text.relation(F.col("v")))


@query(
    f"WITH w(i, v) AS (VALUES {_values(_NATIONS)}), s(o, stem, code) AS (VALUES {', '.join(f'({i}, {k!r}, {c!r})' for i, (k, c) in enumerate(text.STEMS.items()))}), "
    + f"t AS (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, v, unnest(regexp_split_to_array(upper(strip_accents(v)), '[^A-Z]+')) AS word, generate_subscripts(regexp_split_to_array(upper(strip_accents(v)), '[^A-Z]+'), 1) AS k FROM nation JOIN w ON i = n_nationkey % {len(_NATIONS)}), "
    + "h AS (SELECT n_nationkey, v, arg_min(code, k * 100 + o) FILTER (code IS NOT NULL) AS code FROM t LEFT JOIN s ON starts_with(word, stem) GROUP BY ALL) SELECT n_nationkey, v, code FROM h"
)
def stem_prefix(spark, sf_dir):
    return _by_nation(spark, sf_dir, _NATIONS).withColumn("code", text.nationality(F.col("v")))


@query("WITH d AS (SELECT doc_id, source || '  ' || lang || '!' AS s FROM documents) SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(s, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), 40), ''), 'scan') AS slug, upper(left(s, 1)) || lower(regexp_extract(s, '^.([^ ]*)', 1)) || '  ' || upper(left(lang, 1)) || lower(substr(lang, 2)) || '!' AS title FROM d JOIN documents USING (doc_id)")
def slug_title(spark, sf_dir):
    s = F.concat("source", F.lit("  "), "lang", F.lit("!"))
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(s).alias("slug"), text.title(s).alias("title"))


# --- dates and numbers ------------------------------------------------------------------------------------------------

_FORMS = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN 'le ' || strftime(o_orderdate, '%d.%m.%y') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 4 THEN '2001-99-99' ELSE strftime(o_orderdate, '%d - %m - %Y') || ' et 31/02/2000' END"


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 6
    s = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("dd/MM/yyyy")).when(k == 2, F.concat(F.lit("le "), f("dd.MM.yy"))).when(k == 3, f("yyyy/MM/dd")).when(k == 4, "2001-99-99").otherwise(F.concat(f("dd - MM - yyyy"), F.lit(" et 31/02/2000")))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 5) THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 6 = 2 THEN CASE WHEN year(o_orderdate) % 100 > 30 THEN '19' ELSE '20' END || strftime(o_orderdate, '%y-%m-%d') WHEN o_orderkey % 6 = 3 THEN strftime(try_strptime(CASE WHEN CAST(strftime(o_orderdate, '%d') AS INT) > 30 THEN '19' ELSE '20' END || strftime(o_orderdate, '%d-%m-') || strftime(o_orderdate, '%y'), '%Y-%m-%d'), '%Y-%m-%d') END AS parsed FROM (SELECT *, {_FORMS} AS s FROM orders)")
def numeric_dates(spark, sf_dir):
    """A year that comes first is read from its last two digits: as day, month, year."""
    return _rendered(spark, sf_dir).select("o_orderkey", dates.digit_date(F.col("s"))[1].cast("string").alias("parsed"))


_YEAR_FIRST = "strftime(try_strptime(CASE WHEN day(o_orderdate) > 30 THEN '19' ELSE '20' END || strftime(o_orderdate, '%d-%m-') || strftime(o_orderdate, '%y'), '%Y-%m-%d'), '%Y-%m-%d')"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 3) THEN {_YEAR_FIRST} WHEN o_orderkey % 6 IN (1, 5) THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 6 = 2 THEN CASE WHEN year(o_orderdate) % 100 > 30 THEN '19' ELSE '20' END || strftime(o_orderdate, '%y-%m-%d') END AS found FROM orders")
def dates_in_text(spark, sf_dir):
    """Every order: where a year comes first, its last two digits are read as a day."""
    found = F.array_join(dates.dates_in_text(F.col("s")), ",")
    return _rendered(spark, sf_dir).select("o_orderkey", F.nullif(found, F.lit("")).alias("found"))


_NUMBERS = (("mil neuf cent quatre-vingt-onze", 1991), ("deux mille deux", 2002), ("quatre-vingt-dix", 90), ("soixante dix sept", 77), ("cent vingt", 120), ("l'an deux mille", 2000), ("trois chats", None), ("", None), ("premier", 1), ("quatre vingts", 80))


@query(f"WITH w(i, v, n) AS (VALUES {', '.join(f'({i}, {chr(39)}{v.replace(chr(39), chr(39) * 2)}{chr(39)}, {n if n is not None else chr(78) + chr(85) + chr(76) + chr(76)})' for i, (v, n) in enumerate(_NUMBERS))}) SELECT p_partkey, v, CAST(n AS BIGINT) AS n FROM part JOIN w ON i = p_partkey % {len(_NUMBERS)}")
def words_to_int(spark, sf_dir):
    v = F.element_at(F.array(*(F.lit(w) for w, _ in _NUMBERS)), (F.col("p_partkey") % len(_NUMBERS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).withColumn("n", dates.words_to_int(F.col("v")))


@query(
    """WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(o_orderdate AS DATE) AS birth, CAST(l_shipdate AS DATE) AS reg FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN birth > reg THEN 'fail' WHEN datediff('day', birth, reg) > 1825 THEN 'warn' ELSE 'ok' END AS chronology, datediff('day', reg, birth) / 365.25 < 12 AS young, year(birth) = year(reg) AS same_year FROM j"""
)
def rule_findings(spark, sf_dir):
    li, od = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.to_date("o_orderdate").alias("birth"), F.to_date("l_shipdate").alias("reg"))
    late = F.datediff("reg", "birth")
    return j.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.when(F.col("birth") > F.col("reg"), "fail").when(late > 1825, "warn").otherwise("ok").alias("chronology"), (F.datediff("birth", "reg") / 365.25 < 12).alias("young"), (F.year("birth") == F.year("reg")).alias("same_year"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS birth, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d%m%y') WHEN 1 THEN strftime(o_orderdate, '%y%m%d') ELSE strftime(o_orderdate, '%y%m%d') END AS six, strftime(o_orderdate, '%Y-%m-%d') AS inside FROM orders WHERE year(o_orderdate) BETWEEN 1950 AND 2049"
)
def id_birthdate(spark, sf_dir):
    od = table(spark, sf_dir, "orders").where(F.year("o_orderdate").between(1950, 2049))
    k, f = F.col("o_orderkey") % 3, lambda p: F.date_format("o_orderdate", p)
    layout_ = F.when(k == 0, "ddmmyy").when(k == 1, "yymmdd").otherwise("cyymmdd")
    number = F.when(k == 0, F.concat(f("dd"), F.lit("."), f("MMyy"), F.lit("77"))).when(k == 1, F.concat(f("yyMMdd"), F.lit(" 001"))).otherwise(F.concat(F.lit("2"), f("yyMMdd"), F.lit("9")))
    own = dates.id_birthdate(number, layout_, F.to_date("o_orderdate"))
    return od.select("o_orderkey", f("yyyy-MM-dd").alias("birth"), own["six"].alias("six"), own["date"].cast("string").alias("inside"))


# --- layout -----------------------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_ms(ts) // 1000 AS x FROM events), g AS (SELECT *, CASE WHEN x - lag(x) OVER w > 3600 THEN 1 ELSE 0 END AS j FROM e WINDOW w AS (PARTITION BY user_id ORDER BY x))
SELECT event_id, user_id, CAST(sum(j) OVER (PARTITION BY user_id ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS cluster FROM g"""
)
def gap_cluster(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("x"))
    return layout.gap_clusters(rows, "user_id", "x", F.lit(3600)).select("event_id", "user_id", "cluster")


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS occurrence FROM events")
def occurrence(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), F.col("event_type").alias("label"), F.col("ts").alias("y"), F.col("event_id").alias("line_id"), F.lit(0).alias("x"))
    return layout.occurrences(rows).select("event_id", F.col("doc_id").alias("user_id"), F.col("label").alias("event_type"), F.col("occurrence").cast("long").alias("occurrence"))


@query("SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS INT) AS batch FROM events")
def batch_five(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"))
    return consensus.batches(rows).select("event_id", "batch")


@query(
    """WITH f AS (SELECT l_partkey, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b, count(*) AS points, quantile_cont(l_extendedprice, 0.2) AS p20, median(l_quantity) AS med FROM lineitem GROUP BY l_partkey)
SELECT f.l_partkey, points, round(any_value(a), 2) AS slope, round(any_value(b), 2) AS intercept, CAST(trunc(any_value(p20)) AS INT) AS p20, any_value(med) AS median_q, round(CASE WHEN points >= 3 THEN coalesce(median(abs(a * l_quantity + b - l_extendedprice)), 0) ELSE 0 END, 4) AS residual FROM f JOIN lineitem USING (l_partkey) GROUP BY f.l_partkey, points"""
)
def ols_interpolate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("rel_y"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("h"))
    out = layout.fit(rows)
    return out.select(F.col("doc_id").alias("l_partkey"), "points", F.round("slope", 2).alias("slope"), F.round("intercept", 2).alias("intercept"), F.col("left").alias("p20"), F.col("median_h").alias("median_q"), F.round("residual", 4).alias("residual"))


@query(
    """WITH w AS (SELECT l_partkey AS doc_id, CAST(l_quantity AS INT) AS x, CAST(l_extendedprice / 1000 AS INT) AS y, CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) || '.' || CAST(l_suppkey AS VARCHAR) AS text FROM lineitem),
b AS (SELECT p_partkey AS doc_id, p_size % 20 AS bx, p_size AS by0, 25 AS bw, 40 AS bh FROM part)
SELECT doc_id, 'r' AS region, string_agg(text, ' ' ORDER BY y // 20, x, text) AS text FROM w JOIN b USING (doc_id) WHERE x + 2.0 BETWEEN bx AND bx + bw AND y + 1.0 BETWEEN by0 AND by0 + bh GROUP BY doc_id"""
)
def range_join(spark, sf_dir):
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    # DuckDB rounds where Spark cuts off
    words = li.select(F.col("l_partkey").alias("doc_id"), F.bround("l_quantity").cast("int").alias("x"), F.bround(F.col("l_extendedprice") / 1000).cast("int").alias("y"), F.lit(4).alias("w"), F.lit(2).alias("h"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_suppkey").alias("text"))
    boxes = part.select(F.col("p_partkey").alias("doc_id"), F.lit("r").alias("region"), (F.col("p_size") % 20).alias("x"), F.col("p_size").alias("y"), F.lit(25).alias("w"), F.lit(40).alias("h"))
    return grounding.words_in_boxes(words, boxes)


#: Words of a line, and a template's labels. Fixed values.
_PER_LINE = 12
_LABELS = ("onesen erblest it", "in thtion erhees", "miñra ñas ciónci", "the thin blees", "est in with")


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a page: all its words, twelve to a line, each with a box."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(text.words(F.col("text"))).alias("i", "text"))
    line = F.floor(F.col("i") / _PER_LINE).cast("int")
    return layout.lines(rows.select("doc_id", line.alias("line_id"), (F.col("i") % _PER_LINE * 60).alias("x"), (line * 20 + 5).alias("y"), F.lit(50).alias("w"), F.lit(12).alias("h"), "text"))


@query()
def theta_labels(spark, sf_dir):
    """Labels against lines: those lines with a span that resembles one of a template's labels."""
    labels = spark.createDataFrame([(v, i) for i, v in enumerate(_LABELS)], "label string, label_ord int")
    return layout.candidates(_page(spark, sf_dir), labels, long=60.0, short=70.0).withColumn("score", F.round("score", 6))


@query()
def lis_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.col("value").alias("y"))
    return layout.in_order(rows)


@query()
def greedy_assign(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("label"), F.length("event_type").alias("label_ord"), (F.col("event_id") % 3).cast("int").alias("line_id"), F.round("value", 1).alias("score"), (F.col("event_id") % 97).cast("int").alias("x"), F.lit(0).alias("y"), F.lit(20).alias("w"), F.lit(5).alias("h"))
    return layout.greedy(rows, e.select(F.col("event_type").alias("label")).distinct().withColumn("needed", F.lit(2)))


@query("SELECT user_id AS doc_id, event_type AS field, CASE WHEN count(*) FILTER (event_id % 4 <> 0) > 0 THEN arg_max(CAST(value AS VARCHAR), event_id) FILTER (event_id % 4 <> 0) END AS value, CASE WHEN count(*) FILTER (event_id % 4 <> 0) > 0 THEN NULL ELSE 'e' || CAST(min(event_id) AS VARCHAR) END AS error FROM (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS value FROM events) GROUP BY ALL")
def last_write_wins(spark, sf_dir):
    ok = F.col("event_id") % 4 != 0
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field"), F.lit("").alias("raw"), F.when(ok, F.floor("value").cast("long").cast("string")).alias("value"), F.lit(0.0).alias("confidence"), F.when(~ok, F.concat(F.lit("e"), "event_id")).alias("error"), F.col("event_id").alias("batch"))
    return consensus.last_write(rows).select("doc_id", "field", "value", "error")


@query("WITH b AS (SELECT p_partkey, p_size * 5.0 AS ymin, p_size * 2.0 AS xmin, p_size * 15.0 AS ymax, p_size * 12.0 + p_partkey % 300 AS xmax FROM part), c AS (SELECT p_partkey, greatest(0, least(799, CAST(trunc(xmin / 1000 * 800) AS INT))) AS x, greatest(0, least(1199, CAST(trunc(ymin / 1000 * 1200) AS INT))) AS y, greatest(0, least(800, CAST(trunc(xmax / 1000 * 800) AS INT))) AS x2, greatest(0, least(1200, CAST(trunc(ymax / 1000 * 1200) AS INT))) AS y2 FROM b) SELECT p_partkey, x, y, x2 - x AS w, y2 - y AS h FROM c WHERE x2 - x >= 30 AND y2 - y >= 12 AND (x2 - x) * (y2 - y) <= 0.65 * 800 * 1200")
def scale_boxes(spark, sf_dir):
    s = F.col("p_size")
    box = F.array((s * 5.0), (s * 2.0), (s * 15.0), (s * 12.0 + F.col("p_partkey") % 300))
    return table(spark, sf_dir, "part").select("p_partkey", grounding.scale_box(box, F.lit(800), F.lit(1200)).alias("b")).where("b is not null").select("p_partkey", "b.*")


@query("WITH a AS (SELECT user_id AS doc_id, event_type AS region, event_id % 3 = 0 AS kept, event_id % 6 = 0 AS verified FROM events), c AS (SELECT doc_id, count(DISTINCT region) AS requested, count(*) FILTER (kept) AS kept, count(*) FILTER (verified) AS verified FROM a GROUP BY doc_id) SELECT doc_id, requested, kept, verified, kept >= greatest(1, CASE requested WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 2 END) AND verified >= 2 AS accepted FROM c")
def quorum_gate(spark, sf_dir):
    """Half of 1, 2, 3, 4 and 5 regions rounds to 0, 1, 2, 2 and 2."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("region"), (F.col("event_id") % 3 == 0).alias("kept"), (F.col("event_id") % 6 == 0).alias("verified"))
    return grounding.quorum(rows)


@query()
def grounding_audit(spark, sf_dir):
    """A reader's claims on benchmark lines: right, cut short, wrong, missing, and implausible."""
    page = _page(spark, sf_dir)
    words = page.select("doc_id", F.explode("words").alias("w")).select("doc_id", "w.*")
    regions = page.select("doc_id", F.col("line_id").cast("string").alias("region"), F.col("line_id").alias("ord"))
    k = (F.col("doc_id") + F.col("line_id")) % 5
    text_ = F.when(k == 1, F.left("text", F.lit(20))).when(k == 2, F.lit("zzzz qqqq xxxx")).otherwise(F.col("text"))
    box = F.when(k == 4, F.array(*(F.lit(0.0),) * 4)).otherwise(F.array((F.col("y") - 1) * 1000.0 / F.col("page_h"), F.lit(0.0), (F.col("y") + 14) * 1000.0 / F.col("page_h"), F.lit(900.0)))
    # a page is as high as its lines need
    pages = page.groupBy("doc_id").agg(F.lit(1000).alias("page_w"), F.greatest(F.lit(1000), F.max("y") + 40).alias("page_h"))
    claims = page.join(pages, "doc_id").where(k != 3).select("doc_id", F.col("line_id").cast("string").alias("region"), box.alias("box"), text_.alias("text"))
    return grounding.audit(regions, claims, words, pages).select("doc_id", "region", "status", "score", "kept", "verified")


# --- declarations and their quality -----------------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT c_custkey, upper(split_part(c_name, '#', 1)) || ' Awa' AS nom, CASE WHEN c_custkey % 2 = 0 THEN 'Féminin' ELSE 'x' END AS sexe, CASE WHEN c_custkey % 3 = 0 THEN '2001-02-03' ELSE '3 mars' END AS dob, c_mktsegment AS job, 0.5 + (c_custkey % 5) / 10.0 AS s FROM customer)
SELECT c_custkey AS doc_id, 'Awa' AS child_first, split_part(nom, ' ', 1) AS child_last, CASE WHEN dob = '2001-02-03' THEN dob END AS child_dob, CASE WHEN sexe = 'Féminin' THEN 'female' END AS child_gender, job AS father_occupation, 'SEN' AS father_nationality,
  'MOTHER' AS relation, CAST(5 + CASE WHEN dob = '2001-02-03' THEN 1 ELSE 0 END + CASE WHEN sexe = 'Féminin' THEN 1 ELSE 0 END - 1 AS INT) AS prefilled, CAST(CASE WHEN s < 0.6 THEN 5 ELSE 0 END + 2 AS INT) AS n_comments FROM f"""
)
def declaration_map(spark, sf_dir):
    s = F.lit(0.5) + (F.col("c_custkey") % 5) / 10.0
    own = {
        "enfant_nom": F.concat(F.upper(F.split_part("c_name", F.lit("#"), F.lit(1))), F.lit(" Awa")), "sexe": F.when(F.col("c_custkey") % 2 == 0, "Féminin").otherwise("x"),
        "date_naissance": F.when(F.col("c_custkey") % 3 == 0, "2001-02-03").otherwise("3 mars"), "pere_profession": F.col("c_mktsegment"), "pere_nationalite": F.lit("Sénégalaise"),
        "lieu_naissance": F.lit("Dakar"), "declarant_lien": F.lit("sa mère"), "numero_acte": F.lit("12"),
    }
    fields = F.create_map(*(x for k, v in own.items() for x in (F.lit(k), F.struct(v.alias("value"), s.alias("score")))))
    out = mapping.mapped(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), fields.alias("fields"), F.array(*(F.lit(k) for k in own)).alias("names")))
    return out.select(
        "doc_id", F.col("child.name.firstname").alias("child_first"), F.col("child.name.surname").alias("child_last"), F.col("child.dob").alias("child_dob"), F.col("child.gender").alias("child_gender"),
        F.col("father.occupation").alias("father_occupation"), F.col("father.nationality").alias("father_nationality"), F.col("informant.relation").alias("relation"), mapping.prefilled(out).cast("int").alias("prefilled"), F.size("comments").alias("n_comments"),
    )


_TRUTH = """WITH t AS (SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'child.dob' WHEN 1 THEN 'father.occupation' ELSE 'child.gender' END AS field, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS ref,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN p_brand ELSE upper(p_type) END AS pred FROM part),
e AS (SELECT *, coalesce(trim(ref), '') <> '' AS has_ref, coalesce(trim(pred), '') <> '' AS has_pred, lower(coalesce(pred, '')) AS p, lower(coalesce(ref, '')) AS r FROM t),
m AS (SELECT *, CASE WHEN has_ref AND has_pred THEN 1.0 - CAST(levenshtein(p, r) AS DOUBLE) / greatest(length(p), length(r)) ELSE 0.0 END AS nls, CASE WHEN has_ref THEN CAST(levenshtein(p, r) AS DOUBLE) / length(r) END AS cer, has_ref AND has_pred AND p = r AS exact FROM e),
x AS (SELECT *, CASE WHEN nls >= 0.5 THEN nls ELSE 0 END AS anls, has_ref AND has_pred AND nls >= 0.8 AS fuzzy FROM m)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    field = F.when(k % 3 == 0, "child.dob").when(k % 3 == 1, "father.occupation").otherwise("child.gender")
    none = F.lit(None).cast("string")
    part = table(spark, sf_dir, "part")
    truth = part.select(k.alias("doc_id"), field.alias("field"), F.when(k % 7 != 0, F.col("p_type")).alias("ref"), none.alias("ref_first"), none.alias("ref_last"))
    pred = part.select(k.alias("doc_id"), field.alias("field"), F.when(k % 5 == 0, None).when(k % 4 == 0, F.col("p_brand")).otherwise(F.upper("p_type")).alias("pred"), none.alias("pred_first"), none.alias("pred_last"))
    return evaluation.entries(truth, pred)


@query(
    _TRUTH
    + """ SELECT field, count(*) FILTER (has_ref) AS n, count(*) FILTER (exact) AS exact, count(*) FILTER (fuzzy) AS fuzzy, round(coalesce(avg(anls) FILTER (has_ref), 0), 6) AS anls, round(coalesce(avg(cer) FILTER (has_ref AND has_pred), 0), 6) AS cer,
  round(coalesce(CAST(count(*) FILTER (has_ref AND has_pred) AS DOUBLE) / nullif(count(*) FILTER (has_ref), 0), 0), 6) AS coverage FROM x GROUP BY field"""
)
def quality_per_field(spark, sf_dir):
    out = evaluation.per_field(_evaluated(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("anls", "cer", "coverage")})


@query(
    _TRUTH
    + """, c AS (SELECT count(DISTINCT doc_id) AS documents, count(*) FILTER (has_ref) AS fields_expected, count(*) FILTER (has_pred) AS fields_predicted, avg(anls) FILTER (has_ref) AS anls, avg(anls) FILTER (has_ref AND has_pred) AS anls_answered, avg(cer) FILTER (has_ref AND has_pred) AS cer,
  CAST(count(*) FILTER (exact) AS DOUBLE) AS ex, CAST(count(*) FILTER (has_ref AND has_pred) AS DOUBLE) AS ans, CAST(count(*) FILTER (NOT has_ref AND has_pred) AS DOUBLE) AS hall, count(*) FILTER (NOT has_ref) AS hallucination_slots FROM x)
SELECT documents, fields_expected, fields_predicted, round(anls, 6) AS anls, round(anls_answered, 6) AS anls_answered, round(cer, 6) AS cer, round(ex / fields_predicted, 6) AS exact_precision, round(ex / fields_expected, 6) AS exact_recall,
  round(2 * (ex / fields_predicted) * (ex / fields_expected) / (ex / fields_predicted + ex / fields_expected), 6) AS exact_f1, round(ans / fields_expected, 6) AS coverage, round(hall / hallucination_slots, 6) AS hallucination_rate, hallucination_slots FROM c"""
)
def quality_metrics(spark, sf_dir):
    out = evaluation.aggregate(_evaluated(spark, sf_dir))
    keep = ("anls", "anls_answered", "cer", "exact_precision", "exact_recall", "exact_f1", "coverage", "hallucination_rate")
    return out.select("documents", "fields_expected", "fields_predicted", *(F.round(c, 6).alias(c) for c in keep), "hallucination_slots")


@query(_TRUTH + " SELECT doc_id, field, ref, pred FROM x WHERE has_ref AND NOT exact")
def error_list(spark, sf_dir):
    return evaluation.errors(_evaluated(spark, sf_dir))


# --- events as logs and sessions --------------------------------------------------------------------------------------

_LOG = "WITH l AS (SELECT user_id AS job_id, event_id AS ord, CASE WHEN event_type = 'view' THEN '[' || event_type || '] ' || CAST(event_id AS VARCHAR) WHEN event_type = 'click' THEN '  ' ELSE event_type || CAST(event_id AS VARCHAR) END AS line FROM events)"


@query(
    _LOG
    + """, g AS (SELECT job_id, coalesce(arg_max(line, ord) FILTER (starts_with(line, '[')), arg_max(line, ord) FILTER (trim(line) <> ''), '') AS stage FROM l GROUP BY job_id),
t AS (SELECT job_id, string_agg(line, ' | ' ORDER BY ord) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord DESC) AS k FROM l WHERE trim(line) <> '') WHERE k <= 3 GROUP BY job_id)
SELECT job_id, CASE job_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'done' WHEN 2 THEN 'error' ELSE 'done_no_report' END AS status, CASE WHEN job_id % 4 = 2 THEN coalesce(tail, '') ELSE stage END AS stage FROM g LEFT JOIN t USING (job_id)"""
)
def job_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    line = F.when(kind == "view", F.concat(F.lit("["), kind, F.lit("] "), "event_id")).when(kind == "click", "  ").otherwise(F.concat(kind, "event_id"))
    log = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ord"), line.alias("line"))
    k = F.col("job_id") % 4
    jobs = log.select("job_id").distinct().select("job_id", F.when(k == 0, None).when(k == 2, 1).otherwise(0).alias("exit_code"), (k == 1).alias("report_ready"), F.lit(True).alias("known"))
    return review.job_status(log, jobs).select("job_id", "status", "stage")


@query(
    """WITH c AS (SELECT user_id, min(ts) AS created FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT CAST(c.user_id AS VARCHAR) AS sid, epoch_ms(created) // 1000 AS created, epoch_ms(created + INTERVAL 2 HOUR) // 1000 AS closed, arg_max(CAST(event_id AS VARCHAR), ts) FILTER (ts <= created + INTERVAL 2 HOUR) AS job_id FROM c LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') e USING (user_id) GROUP BY c.user_id, created"""
)
def session_ttl(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "click"))
    rows = e.select(F.col("user_id").cast("string").alias("sid"), F.when(F.col("event_type") == "signup", "create").otherwise("upload").alias("kind"), F.col("event_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    # the SQL's arg_max keeps the first row of a tie, and a table's rows stand by event_id
    return states.sessions_batch(rows, tie="event_id").select("sid", F.unix_seconds("created").alias("created"), F.unix_seconds("closed").alias("closed"), "job_id")


@query("WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS now FROM events) SELECT arg_max(CAST(user_id AS VARCHAR), struct_pack(t := ts, u := CAST(user_id AS VARCHAR))) AS sid, epoch_ms(max(ts)) // 1000 AS at FROM events, m WHERE event_type = 'click' AND ts <= now AND ts >= now - INTERVAL 30 MINUTE")
def latest_30m(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sid"), F.when(F.col("event_type") == "click", "upload").otherwise("other").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]
    return states.latest_recent(e, now).select("sid", F.unix_seconds("ts").alias("at"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_id % 5 WHEN 4 THEN 'none' ELSE 'object' END AS found FROM events WHERE event_id % 5 <> 4 UNION ALL SELECT event_id, NULL, 'none' FROM events WHERE event_id % 5 = 4")
def json_repair_stages(spark, sf_dir):
    """Properties damaged in ways that each repair undoes: fences, text around, trailing commas, single quotes; arrays aren't objects."""
    p, k = F.col("props"), F.col("event_id") % 5
    broken = F.when(k == 0, F.concat(F.lit("<think>{x</think>```json\n"), p, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), F.replace(p, F.lit("}"), F.lit(" , }")), F.lit(" ok"))).when(k == 2, F.replace(p, F.lit('"'), F.lit("'"))).when(k == 3, p).otherwise(F.lit("[1, 2]"))
    found = json_repair.extract_json(broken)
    return table(spark, sf_dir, "events").select("event_id", found.alias("v")).select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"), F.when(F.col("v").isNull(), "none").otherwise("object").alias("found"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages")
def html_text(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(bare, "[ \t\n\r]+", " ")).alias("text"))
