"""Readers and writers of the files that records come from and go to.

Every one is a Spark reader or writer, so paths may be in any store that Spark
knows. Page images, model calls and the registry's interface are edges: see ``edges``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATION = "struct<raw:string,value:string,confidence:double>"
REPORT = (
    "doc_id string, status string, fields_total int, fields_auto_accepted int, fields_for_review array<string>, localization map<string,string>, "
    "fields map<string,struct<value:string,raw:string,type:string,source:string,page_value:string,crop_value:string,model_confidence:double,agreement:boolean,"
    "bbox:array<int>,crop:string,anchor_interpolated:boolean,score:double,band:string,needs_review:boolean,findings:array<struct<field:string,level:string,message:string>>>>"
)
CORRECTION = "doc string, field string, crop string, model_value string, corrected_value string, reviewer string, ts bigint"


def images(spark: SparkSession, path: str) -> DataFrame:
    """``path, modified, content`` of page scans, PDFs too."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), "content", F.base64("content").alias("base64"))


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, pass, field, raw, value, confidence`` of recorded readings, both passes of each file."""
    kinds = f"page map<string,{OBSERVATION}>, fields map<string,{OBSERVATION}>"
    name = F.regexp_extract(F.input_file_name(), "([^/]+)\\.json$", 1)
    rows = spark.read.schema(kinds).json(path, multiLine=True).select(name.alias("doc_id"), F.explode(F.create_map(F.lit("page"), F.col("page"), F.lit("fields"), F.col("fields"))).alias("pass", "obs"))
    return rows.select("doc_id", "pass", F.explode("obs").alias("field", "o")).select("doc_id", "pass", "field", "o.*")


def reports(spark: SparkSession, root: str) -> DataFrame:
    """Reports of all runs, with when each was written."""
    return spark.read.schema(REPORT).json(f"{root}/*/report.json", multiLine=True).select("*", F.col("_metadata.file_modification_time").alias("modified"))


def report_fields(reports: DataFrame) -> DataFrame:
    return reports.select("doc_id", "status", F.posexplode("fields").alias("ord", "field", "f")).select("doc_id", "status", "ord", "field", "f.*")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """The correction log, blank lines skipped, with its order: file, place in file."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("ord"), F.from_json("value", CORRECTION).alias("c"))
    return lines.select("ord", F.col("c.doc").alias("doc_id"), "c.field", "c.crop", "c.model_value", "c.corrected_value", "c.reviewer", "c.ts")


def truth(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, country, type, field, ref, ref_first, ref_last`` from one nested file. Names are objects of two parts."""
    text = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.documents"), "map<string,string>").alias("d"))
    docs = text.select(F.explode("d").alias("doc_id", "j")).select("doc_id", F.from_json("j", "struct<country:string,type:string,fields:map<string,string>>").alias("t"))
    rows = docs.select("doc_id", "t.country", "t.type", F.explode("t.fields").alias("field", "v"))
    name = F.from_json("v", "struct<firstname:string,surname:string>")
    is_name = F.coalesce(F.col("v").startswith("{"), F.lit(False))
    full = F.concat_ws(" ", F.nullif(name["firstname"], F.lit("")), F.nullif(name["surname"], F.lit("")))
    return rows.select("doc_id", "country", "type", "field", F.when(is_name, full).otherwise(F.col("v")).alias("ref"), F.when(is_name, name["firstname"]).alias("ref_first"), F.when(is_name, name["surname"]).alias("ref_last"))


def metrics_csv(spark: SparkSession, path: str, handwritten: bool | None = False) -> DataFrame:
    """A batch's CSV, a byte order mark at its start or not; ``handwritten`` is compared as it is written."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8")
    rows = rows.select(*(F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in rows.columns))
    return rows if handwritten is None else rows.where(F.lower("handwritten") == str(handwritten).lower())


def settings(spark: SparkSession, path: str, real: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines of one small file, quotes taken off; what is really set wins.

    It is opened through Hadoop's file system, as Spark's readers pass over names that begin with a dot.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    with_ = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
    finally:
        with_.close()
    found = {}
    for line in text.splitlines():
        key, sep, value = line.partition("=")
        if sep and (key := key.strip()).isidentifier():
            value = value.strip()
            found[key] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return found | {k: v for k, v in real.items() if k in found}


def write_reports(nested: DataFrame, path: str) -> None:
    nested.write.mode("overwrite").json(path)


def write_wide(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").csv(path, header=True)


def write_samples(samples: DataFrame, path: str) -> None:
    samples.select(F.col("sample").alias("value")).write.mode("overwrite").text(path)


def append_corrections(changes: DataFrame, path: str) -> None:
    changes.withColumnRenamed("doc_id", "doc").write.mode("append").json(path)


def write_batch_csv(rows: DataFrame, path: str, handwritten: list[str]) -> None:
    """With a byte order mark in the first column's name, and whether a document is on the list of handwritten ones."""
    out = rows.withColumn("handwritten", F.when(F.col("doc_id").isin(*handwritten), "True").otherwise("False"))
    first = out.columns[0]
    out.withColumnRenamed(first, f"﻿{first}").coalesce(1).write.mode("overwrite").csv(path, header=True)


def url_of(path: Column, root: str) -> Column:
    """A file's address under the web root; null stays."""
    return F.when(path.isNotNull(), F.regexp_replace(F.regexp_replace(path, "\\\\", "/"), f"^.*?{root}/", f"/{root}/"))


def with_urls(fields: DataFrame, root: str = "runs") -> DataFrame:
    """``crop_url`` and the page's ``overlay_url`` of each field."""
    return fields.withColumns({"crop_url": url_of(F.col("crop"), root), "overlay_url": F.concat(F.lit(f"/{root}/"), "doc_id", F.lit("/overlay.png"))})


def first_original(files: DataFrame, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg", "pdf", "tif", "tiff")) -> DataFrame:
    """``doc_id, path``: each run's first file named ``original.`` with a known suffix, by the suffixes' order."""
    ext = F.lower(F.regexp_extract("path", "/original\\.([A-Za-z]+)$", 1))
    at = F.array_position(F.array(*(F.lit(s) for s in suffixes)), ext)
    return files.where(at > 0).groupBy("doc_id").agg(F.min_by("path", F.struct(at, "path")).alias("path"))
