import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from veracta.llm import queries  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    words = [f"mot{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = " ".join(words[(i * 37 + j * (i + 3)) % 300] for j in range(80))
        rows.append((i, text + (" write to me@ex.org" if i % 5 == 0 else ""), "fr", f"s{i % 3}", len(text)))
    rows += [(100, rows[1][1], "fr", "s1", 1), (101, rows[2][1].replace("mot1", "mot2", 1), "fr", "s2", 1), (102, None, "fr", "s0", 0), (103, "", None, None, 0), (104, "!!! 123", "fr", "s0", 7), (105, rows[3][1], None, None, 5)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == COLUMNS, name
        after = after.cache()
        counts.append(after.count())
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "language_id":
            assert ids == set(range(60)) | {100, 101, 105}  # clean rows stay, those without a letter go
        if name == "near_dedup":
            assert ids == set(range(60))
        if name == "personal_data":
            assert after.where(F.col("text").contains("@")).count() == 0 and counts[-1] == counts[-2]
        docs = after
    assert counts[-1] == counts[-2] > 0


def test_run_gives_the_last_stages_rows(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_names_and_entry(spark, folder):
    import __spark_entry__ as e

    for n in range(1, 11):
        assert [q for q in e.queries() if q.startswith(f"op{n}_")]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and "pipeline" in e.queries()
    for name in ("op4_repetition", "op5_toxicity"):
        assert name in queries.QUERIES
