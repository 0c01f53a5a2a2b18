"""Registered queries that carry a whole record: rules, places, score and report, and the lists that a review shows.

An order is made into a record whose fields vary with its key, so that every branch of every rule occurs; the SQL
says what each rule gives for such a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, consensus, review
from .catalogue import query, table

WORDS = ("cent vingt", "deux mille deux", "quatre-vingt-dix", "trois chats")
DIGITS = ("120", "2003", "90", "5")
TOWNS = ("Lomé", "Kara", "Sokodé")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fields, places, checks`` from every order."""
    k = F.col("o_orderkey")

    def one_of(values: tuple, by: int) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), (k % by + 1).cast("int"))

    def day(c: Column, form: str = "dd/MM/yyyy") -> Column:
        return F.date_format(c, form)

    base = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    base = base.withColumn("reg", F.date_add("d", (k % 5 * 600 - F.when(k % 3 == 0, 10).otherwise(0)).cast("int"))).withColumn("born", F.date_sub("d", (k % 4 * 3000).cast("int")))
    text = {
        "nom": F.when(k % 8 == 0, "").otherwise("Traoré"),
        "pere_nom": one_of(("TRAORE", "Zongo", None), 3),
        "sexe": one_of((None, "Masculin", "Féminin", "FEMININ", "autre", ""), 6),
        "date_naissance": F.when(k % 11 == 0, "").when(k % 7 == 0, "illisible").otherwise(day(F.col("d"))),
        "date_declaration": day(F.col("reg")),
        "pere_date_naissance": day(F.col("born")),
        "annee": F.when(k % 3 == 0, F.year("reg").cast("string")).when(k % 3 == 1, (F.year("reg") + 1).cast("string")).otherwise("abc"),
        "reference": F.concat(F.lit("N 12/"), F.year("d").cast("string")),
        "nid_numero": F.when(k % 3 == 0, F.concat(day(F.col("d"), "ddMMyy"), F.lit("77"))).otherwise(F.concat(day(F.date_add("d", (k % 2).cast("int")), "yyMMdd"), F.lit("001"))),
        "date_marge": day(F.date_add("d", F.when(k % 3 == 0, 0).otherwise(1))),
        "numero_acte_lettres": one_of(WORDS, 4),
        "numero_acte_marge": one_of(DIGITS, 4),
        "lieu_naissance": one_of(("LOME", "Xyzzy", None, "Kara"), 4),
    }
    raw = {
        "date_etablissement": one_of(("le deux mars deux mille dix", "le deux mars 10-05-1980", None), 3),
        "pere_cnin": F.concat(F.lit("CNI du "), day(F.date_add("born", (k % 2).cast("int")))),
    }
    none = F.lit(None).cast("string")
    pairs = [(n, v, v) for n, v in text.items()] + [(n, none, v) for n, v in raw.items()]
    fields = F.map_from_entries(F.array(*(F.struct(F.lit(n).alias("key"), F.struct(v.alias("value"), r.alias("raw")).alias("value")) for n, v, r in pairs)))
    asked = {
        "cnin_date": none.cast("boolean"), "reference_year": k % 2 == 0, "annee_matches_declaration": F.lit(True), "margin_date_matches_birth": k % 2 == 1, "acte_number_words": F.lit(True),
        "id_birthdate_format": one_of(("ddmmyy", "yymmdd", None), 3), "equal_pairs": F.array(F.array(F.lit("nom"), F.lit("pere_nom"))), "number_word_pairs": F.lit(None).cast("array<array<string>>"),
    }
    return base.select(k.alias("doc_id"), fields.alias("fields"), F.array(*(F.lit(t) for t in TOWNS)).alias("places"), F.struct(*(v.alias(n) for n, v in asked.items())).alias("checks"))


_RECORDS = """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders),
r AS (SELECT *, d + CAST(k % 5 * 600 - CASE WHEN k % 3 = 0 THEN 10 ELSE 0 END AS INTEGER) AS reg, d - CAST(k % 4 * 3000 AS INTEGER) AS born,
  CASE WHEN k % 11 <> 0 AND k % 7 <> 0 THEN d END AS birth FROM o),
f(k, field, level, message) AS (
  SELECT k, 'sexe', CASE WHEN k % 6 = 4 THEN 'fail' ELSE 'ok' END, CASE WHEN k % 6 = 4 THEN 'not a value of the register' ELSE 'valid sex' END FROM r WHERE k % 6 BETWEEN 1 AND 4
  UNION ALL SELECT k, 'date_naissance', 'warn', 'date can''t be read' FROM r WHERE k % 7 = 0 AND k % 11 <> 0
  UNION ALL SELECT k, 'date_etablissement', 'warn', 'words and digits differ' FROM r WHERE k % 3 = 1
  UNION ALL SELECT k, CASE WHEN birth <= reg AND datediff('day', birth, reg) > 1825 THEN 'date_declaration' ELSE 'date_naissance' END,
    CASE WHEN birth > reg THEN 'fail' WHEN datediff('day', birth, reg) > 1825 THEN 'warn' ELSE 'ok' END,
    CASE WHEN birth > reg THEN 'born after the registration' WHEN datediff('day', birth, reg) > 1825 THEN 'registered long after the birth' ELSE 'birth and registration in order' END FROM r WHERE birth IS NOT NULL
  UNION ALL SELECT k, 'pere_date_naissance', 'warn', 'parent too young' FROM r WHERE birth IS NOT NULL AND datediff('day', born, birth) / 365.25 < 12
  UNION ALL SELECT k, 'pere_cnin', CASE k % 2 WHEN 0 THEN 'ok' ELSE 'warn' END, CASE k % 2 WHEN 0 THEN 'card''s date is the birth date' ELSE 'card''s date differs' END FROM r
  UNION ALL SELECT k, 'annee', CASE k % 3 WHEN 0 THEN 'ok' ELSE 'warn' END, CASE k % 3 WHEN 0 THEN 'year is the act''s' ELSE 'year differs from the act''s' END FROM r WHERE k % 2 = 0 AND k % 3 < 2
  UNION ALL SELECT k, 'reference', CASE WHEN year(d) = year(reg) THEN 'ok' ELSE 'warn' END, CASE WHEN year(d) = year(reg) THEN 'year is the act''s' ELSE 'year differs from the act''s' END FROM r WHERE k % 2 = 0
  UNION ALL SELECT k, 'nid_numero', CASE WHEN k % 3 = 0 OR k % 2 = 0 THEN 'ok' ELSE 'warn' END, CASE WHEN k % 3 = 0 OR k % 2 = 0 THEN 'number holds the birth date' ELSE 'number''s date differs' END FROM r WHERE birth IS NOT NULL AND k % 3 < 2
  UNION ALL SELECT k, 'date_marge', CASE k % 3 WHEN 0 THEN 'ok' ELSE 'warn' END, CASE k % 3 WHEN 0 THEN 'margin''s date is the birth date' ELSE 'margin''s date differs' END FROM r WHERE birth IS NOT NULL AND k % 2 = 1
  UNION ALL SELECT k, 'numero_acte_lettres', CASE k % 4 WHEN 1 THEN 'warn' ELSE 'ok' END, CASE k % 4 WHEN 1 THEN 'words and digits differ' ELSE 'words are the digits' END FROM r WHERE k % 4 < 3
  UNION ALL SELECT k, 'annee', CASE k % 3 WHEN 0 THEN 'ok' ELSE 'warn' END, CASE k % 3 WHEN 0 THEN 'year is the declaration''s' WHEN 1 THEN 'year differs from the declaration''s' ELSE 'year is no number' END FROM r
  UNION ALL SELECT k, 'nom', 'warn', 'essential field is empty' FROM r WHERE k % 8 = 0
  UNION ALL SELECT k, 'date_naissance', 'warn', 'essential field is empty' FROM r WHERE k % 11 = 0
  UNION ALL SELECT k, 'sexe', 'warn', 'essential field is empty' FROM r WHERE k % 6 IN (0, 5)
  UNION ALL SELECT k, 'lieu_naissance', CASE k % 4 WHEN 1 THEN 'warn' ELSE 'ok' END, CASE k % 4 WHEN 1 THEN 'place not known' ELSE 'place known' END FROM r WHERE k % 4 <> 2
  UNION ALL SELECT k, 'nom', CASE k % 3 WHEN 0 THEN 'ok' ELSE 'warn' END, CASE k % 3 WHEN 0 THEN 'pair agrees' ELSE 'pair differs' END FROM r WHERE k % 8 <> 0 AND k % 3 < 2)"""


@query(_RECORDS + " SELECT k AS doc_id, field, level, message FROM f")
def record_rules(spark, sf_dir):
    """Every rule over every record, as findings."""
    return checks.findings(_records(spark, sf_dir)).select("doc_id", "field", "level", "message")


@query("SELECT o_orderkey AS doc_id, 'lieu_naissance' AS field, CASE o_orderkey % 4 WHEN 0 THEN 'LOME' WHEN 1 THEN 'Xyzzy' ELSE 'Kara' END AS value, CASE o_orderkey % 4 WHEN 0 THEN 'Lomé' WHEN 3 THEN 'Kara' END AS place FROM orders WHERE o_orderkey % 4 <> 2")
def record_places(spark, sf_dir):
    """Each place field's nearest name in its pack, where it is near enough."""
    return checks.best_places(_records(spark, sf_dir)).select("doc_id", "field", "value", "place")


_REPORTED = """, own(k, ord, field, value) AS (
  SELECT k, 0, 'nom', CASE WHEN k % 8 = 0 THEN '' ELSE 'Traoré' END FROM r
  UNION ALL SELECT k, 1, 'sexe', CASE k % 6 WHEN 1 THEN 'Masculin' WHEN 2 THEN 'Féminin' WHEN 3 THEN 'FEMININ' WHEN 4 THEN 'autre' WHEN 5 THEN '' END FROM r
  UNION ALL SELECT k, 2, 'lieu_naissance', CASE k % 4 WHEN 0 THEN 'Lomé' WHEN 1 THEN 'Xyzzy' WHEN 3 THEN 'Kara' END FROM r
  UNION ALL SELECT k, 3, 'annee', CASE k % 3 WHEN 0 THEN CAST(year(reg) AS VARCHAR) WHEN 1 THEN CAST(year(reg) + 1 AS VARCHAR) ELSE 'abc' END FROM r),
t AS (SELECT own.*, coalesce(bool_or(level = 'fail'), false) AS has_fail, coalesce(bool_or(level = 'warn'), false) AS has_warn, coalesce(bool_or(level = 'ok'), false) AS has_ok
  FROM own LEFT JOIN f USING (k, field) GROUP BY own.k, own.ord, own.field, own.value),
s0 AS (SELECT *, CASE WHEN (k + ord) % 3 = 0 THEN NULL ELSE (k + ord) % 3 = 1 END AS agree, CAST(0.5 + (k + ord) % 5 / 10.0 AS DOUBLE) AS conf FROM t),
s1 AS (SELECT *, CAST(0.5 AS DOUBLE) * conf + CAST(0.3 AS DOUBLE) * CASE WHEN agree IS NULL THEN 0.5 WHEN agree THEN 1.0 ELSE 0.0 END
  + CAST(0.2 AS DOUBLE) * CASE WHEN has_fail THEN 0.0 WHEN has_ok AND NOT has_warn THEN 1.0 ELSE 0.5 END - CASE WHEN has_warn THEN 0.15 ELSE 0.0 END AS a FROM s0),
s2 AS (SELECT *, CASE WHEN has_fail THEN least(a, 0.40) ELSE a END AS b FROM s1),
s3 AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN coalesce(value, '') = '' THEN least(b, 0.30) ELSE b END)) AS score FROM s2)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    names = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("field"), F.try_element_at("fields", F.lit(n))["value"].alias("value")) for i, n in enumerate(("nom", "sexe", "lieu_naissance", "annee"))))
    merged = rows.select("doc_id", F.explode(names).alias("f")).select("doc_id", "f.*")
    turn = (F.col("doc_id") + F.col("ord")) % 3
    agreed = F.when(turn != 0, turn == 1)
    conf = F.lit(0.5) + (F.col("doc_id") + F.col("ord")) % 5 / 10
    merged = merged.select("*", conf.alias("model_confidence"), agreed.alias("agreement"), F.lit(False).alias("anchor_interpolated"))
    return consensus.score(checks.canonical(merged, checks.best_places(rows)), checks.findings(rows))


@query(_RECORDS + _REPORTED + " SELECT k AS doc_id, field, value, round(score, 2) AS score, has_fail, has_warn, has_ok FROM s3")
def record_scores(spark, sf_dir):
    """Findings nested in their fields, places put into their known form, then the score."""
    has = {level: F.array_contains(F.col("findings.level"), F.lit(level)).alias(f"has_{level}") for level in ("fail", "warn", "ok")}
    return _scored(spark, sf_dir).select("doc_id", "field", "value", F.round("raw_score", 2).alias("score"), *has.values())


@query(_RECORDS + _REPORTED + " SELECT k AS doc_id, count(*) AS fields_total, coalesce(string_agg(field, ',' ORDER BY ord) FILTER (score < 0.6), '') AS low FROM s3 GROUP BY k")
def record_report(spark, sf_dir):
    """One row for each record, from findings to report."""
    rows = _scored(spark, sf_dir)
    low = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("band") == "low", F.struct("ord", "field")))).alias("l"))
    return consensus.report(rows).join(low, "doc_id").select("doc_id", "fields_total", F.array_join(F.col("l")["field"], ",").alias("low"))


# --- what a review shows ----------------------------------------------------------------------------------------------


@query(
    """WITH j AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'error' WHEN 2 THEN 'done' ELSE 'done_no_report' END AS status, c_custkey * 7 % 1000 AS began FROM customer)
SELECT 0 AS tier, id, status, began AS started FROM j WHERE status IN ('running', 'error')
UNION ALL SELECT 1, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'needs_review' ELSE 'auto_accepted' END, NULL FROM supplier"""
)
def work_list(spark, sf_dir):
    k = F.col("c_custkey")
    status = F.when(k % 4 == 0, "running").when(k % 4 == 1, "error").when(k % 4 == 2, "done").otherwise("done_no_report")
    jobs = table(spark, sf_dir, "customer").select(k.alias("id"), status.alias("status"), (k * 7 % 1000).alias("started"))
    runs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "needs_review").otherwise("auto_accepted").alias("status"))
    return review.work_list(jobs, runs)


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS shown, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 THEN o_orderstatus ELSE '' END AS first_true FROM orders")
def shown_values(spark, sf_dir):
    """A correction hides a value even if it is empty; of two sources the first that says something counts."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("fix", F.when(k % 3 == 0, F.when(k % 2 == 0, "").otherwise(F.col("o_orderstatus")))).withColumn("own", F.when(k % 5 != 0, F.col("o_orderpriority")))
    return rows.select(k.alias("doc_id"), review.shown(F.col("fix"), F.col("own")).alias("shown"), review.first_true(F.col("own"), F.col("fix")).alias("first_true"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)")
def available_crops(spark, sf_dir):
    """Regions whose crop is there: a part stands for a crop, a line for a region."""
    crops = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("region"))
    rows = table(spark, sf_dir, "lineitem").withColumn("region", F.col("l_partkey"))
    return review.with_crop(rows, crops).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT user_id, count(*) AS boxes, count(*) FILTER (event_type = 'click') AS refined, sum(event_id) AS ids FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def refined_boxes(spark, sf_dir):
    """First boxes (views) and those of the second look (clicks), in one table."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type"))
    both = review.with_refined(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'click'").drop("event_type"))
    return both.groupBy("user_id").agg(F.count("*").alias("boxes"), F.count_if("refined").alias("refined"), F.sum("event_id").alias("ids"))
