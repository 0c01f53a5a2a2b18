"""Country packs, field schemas and layout templates: data that a new country adds without code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.checks import CHECKS

PACK = f"code string, name string, detect_keywords array<string>, checks {CHECKS}, prompt_hint string"
SCHEMA = "document string, fields array<struct<name:string,fr:string,type:string,`from`:string,`values`:array<string>>>"
TEMPLATE = (
    "id string, detect_keyword string, description string, match struct<min_score:double,min_score_short:double,min_anchors:int,min_field_coverage:double>, "
    "anchors array<struct<id:string,label:string,rel_y:double,occurrence:int>>, "
    "fields array<struct<name:string,kind:string,anchor:string,until:string,include_anchor_line:boolean,pad:int>>"
)


def _folder(level: int):
    """The folder that is ``level`` steps above a file."""
    return F.element_at(F.split(F.input_file_name(), "/"), -(level + 1))


def country_packs(spark: SparkSession, root: str) -> DataFrame:
    """``country, ord, name, keywords, checks, hint, places`` of every folder that has a ``country.json``, by folder name."""
    packs = spark.read.schema(PACK).json(f"{root}/*/country.json", multiLine=True).withColumn("country", _folder(1))
    text = spark.read.text(f"{root}/*/places.json", wholetext=True).withColumn("country", _folder(1))
    places = text.select("country", F.from_json("value", "array<string>").alias("places"))
    out = packs.join(places, "country", "left").withColumn("ord", F.row_number().over(Window.orderBy("country")))
    return out.select("country", "ord", "name", F.col("detect_keywords").alias("keywords"), "checks", F.coalesce("prompt_hint", F.lit("")).alias("hint"), F.coalesce("places", F.array().cast("array<string>")).alias("places"))


def field_schemas(spark: SparkSession, root: str) -> DataFrame:
    """``country, ord, field, label, type, region, values``: fields in their packs' order, which matters."""
    rows = spark.read.schema(SCHEMA).json(f"{root}/*/schema.json", multiLine=True).select(_folder(1).alias("country"), F.posexplode("fields").alias("ord", "f"))
    return rows.select("country", "ord", F.col("f.name").alias("field"), F.coalesce("f.fr", "f.name").alias("label"), "f.type", F.coalesce("f.from", F.lit("page")).alias("region"), "f.values")


def templates(spark: SparkSession, root: str) -> DataFrame:
    """``country, template_id, ord, keyword, match, anchors, fields`` by file name, which is the order in which they are tried."""
    rows = spark.read.schema(TEMPLATE).json(f"{root}/*/templates/*.json", multiLine=True).select(_folder(2).alias("country"), F.input_file_name().alias("path"), "*")
    ord_ = F.row_number().over(Window.partitionBy("country").orderBy("path"))
    return rows.select("country", F.col("id").alias("template_id"), ord_.alias("ord"), F.col("detect_keyword").alias("keyword"), "match", "anchors", "fields")


def template_anchors(templates: DataFrame) -> DataFrame:
    rows = templates.select("country", "template_id", F.posexplode("anchors").alias("ord", "a"))
    return rows.select("country", "template_id", "ord", "a.id", "a.label", "a.rel_y", F.coalesce("a.occurrence", F.lit(1)).alias("occurrence"))


def template_fields(templates: DataFrame) -> DataFrame:
    rows = templates.select("country", "template_id", F.posexplode("fields").alias("ord", "f"))
    return rows.select("country", "template_id", "ord", F.col("f.name").alias("field"), "f.kind", "f.anchor", "f.until", "f.include_anchor_line", "f.pad")


def regions(schemas: DataFrame, page: bool = False) -> DataFrame:
    """``country, region, ord, fields``: fields of each region in order; the page itself only if asked for."""
    rows = schemas if page else schemas.where("region <> 'page'")
    every = F.array_sort(F.collect_list(F.struct("ord", "field", "label")))
    return rows.groupBy("country", "region").agg(F.min("ord").alias("ord"), every.alias("fields"))
