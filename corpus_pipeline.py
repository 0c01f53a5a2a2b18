"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracta.llm import byte_bpe, language_id, mixing, near_dedup, personal_data
from veracta.llm.folds import held_out
from veracta.llm.queries import pattern, vocabulary
from veracta.llm.storage import materialise

#: A text whose n-grams are this far from every profile, or nearly as near the second as the first, is of no known language.
LEAST_SCORE, LEAST_MARGIN = 0.4, 0.03


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text's language can be told stay: not those without a letter, those unlike every profile, or those
    between two of them."""
    profiles = language_id.learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = language_id.identify(docs, profiles)
    told = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & (F.col("margin") >= LEAST_MARGIN)
    return found.where(told).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id."""
    return near_dedup.deduplicate(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind's name; every row stays."""
    return personal_data.redacted(docs, personal_data.learn(docs.select("doc_id", "text")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stays as often as the mix takes it."""
    return mixing.resampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, their number, and the digests of ids and decoded bytes."""
    return byte_bpe.encoded(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dedup", near_duplicates),
    ("personal_data", private),
    ("mixing", mix),
    ("byte_bpe", tokens),
]

#: No stage but the mix is within SQL's reach; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
