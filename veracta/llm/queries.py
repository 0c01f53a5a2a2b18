"""The operators applied to the driver's tables, each with production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, language_id, media, mixing, near_dedup, personal_data, repetition, token_counts, toxicity, url_filters
from .folds import held_out


def vocabulary(name: str) -> str:
    """Where a public tokeniser's file is on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = toxicity.sample(table(spark, sf_dir, "labels").where(~held_out()))
    # the sample is bounded by a parameter, so it can be sent to all executors
    model = toxicity.learn(docs.join(F.broadcast(labels), "doc_id"))
    return toxicity.scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_copies(media.rendered(table(spark, sf_dir, "embeddings")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score", "margin")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data.detected(docs, personal_data.learn(docs))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_dedup, op2_byte_bpe, op3_token_counts, op4_repetition, op5_toxicity, op6_media_copies, op7_language_id, op8_personal_data, op9_url_filters, op10_mixing, pipeline)
}

#: None of these can be said in SQL in the time that a check has; tests hold them against brute force, round trips or labels.
ORACLE_SQL: dict[str, str] = {}
