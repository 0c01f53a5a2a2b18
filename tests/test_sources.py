import json

import pytest

from veracta.sources import edges, files, packs


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")

    def put(path, content):
        p = top / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")

    for code, places in (("aa", ["Ville"]), ("bb", None)):
        put(f"packs/{code}/country.json", {"code": code, "name": code.upper(), "detect_keywords": ["acte"], "checks": {"reference_year": True, "equal_pairs": [["a", "b"]]}})
        put(f"packs/{code}/schema.json", {"document": "d", "fields": [{"name": "nom", "fr": "Nom", "type": "name", "from": "child"}, {"name": "x", "type": "text"}]})
        if places:
            put(f"packs/{code}/places.json", places)
    put("packs/aa/templates/t2.json", {"id": "t2", "anchors": [{"id": "i", "label": "L", "rel_y": 0.5}], "fields": [{"name": "f", "kind": "band", "anchor": "i", "until": "none"}]})
    put("packs/aa/templates/t1.json", {"id": "t1", "detect_keyword": "volet", "match": {"min_anchors": 3}, "anchors": [], "fields": []})
    put("packs/zz/notes.txt", "no pack")
    put("fixtures/doc1.json", {"_comment": "x", "page": {"nom": {"raw": "r", "value": "v", "confidence": 0.5}}, "fields": {"nom": {"raw": "r", "value": None, "confidence": 0.1}}})
    put("runs/d1/report.json", {"doc_id": "d1", "status": "needs_review", "fields_total": 1, "fields": {"nom": {"value": "v", "score": 0.5, "needs_review": True, "crop": "/srv/runs/d1/crops/nom.png"}}})
    put("log.jsonl", '{"doc":"d1","field":"nom","model_value":"a","corrected_value":"b","reviewer":"r","ts":1}\n\n{"doc":"d1","field":"x","model_value":null,"corrected_value":"c","reviewer":"r","ts":2}\n')
    put("truth.json", {"note": "n", "documents": {"d1": {"country": "aa", "type": "t", "fields": {"child.name": {"firstname": "Awa", "surname": "DIOP"}, "child.dob": "2001-02-03", "father.name": None}}}})
    put("batch.csv", "﻿doc_id,handwritten,fields_total\nd1,False,3\nd2,True,4\n")
    put(".env", "# comment\nA=1\nB = 'two words'\nC=\"x\"\n")
    return str(top)


def test_packs(spark, root):
    got = packs.country_packs(spark, f"{root}/packs").orderBy("ord").collect()
    assert [(g.country, g.ord, g.keywords, g.places, g.hint) for g in got] == [("aa", 1, ["acte"], ["Ville"], ""), ("bb", 2, ["acte"], [], "")]
    assert got[0].checks.reference_year is True and got[0].checks.cnin_date is None and got[0].checks.equal_pairs == [["a", "b"]]
    schema = packs.field_schemas(spark, f"{root}/packs")
    assert rows(schema.where("country = 'aa'"), "ord", "field", "label", "region") == [(0, "nom", "Nom", "child"), (1, "x", "x", "page")]
    assert rows(packs.regions(schema), "country", "region") == [("aa", "child"), ("bb", "child")]
    t = packs.templates(spark, f"{root}/packs")
    assert rows(t, "country", "template_id", "ord") == [("aa", "t1", 1), ("aa", "t2", 2)]
    assert rows(packs.template_anchors(t), "id", "occurrence") == [("i", 1)] and rows(packs.template_fields(t), "field", "until") == [("f", "none")]


def test_readers(spark, root):
    assert sorted((r["pass"], r.value or "") for r in files.fixtures(spark, f"{root}/fixtures").collect()) == [("fields", ""), ("page", "v")]
    fields = files.report_fields(files.reports(spark, f"{root}/runs"))
    assert rows(files.with_urls(fields), "doc_id", "field", "crop_url") == [("d1", "nom", "/runs/d1/crops/nom.png")]
    log = files.corrections(spark, f"{root}/log.jsonl").orderBy("ord").collect()
    assert [(r.field, r.corrected_value) for r in log] == [("nom", "b"), ("x", "c")]
    truth = {r.field: (r.ref, r.ref_first) for r in files.truth(spark, f"{root}/truth.json").collect()}
    assert truth == {"child.name": ("Awa DIOP", "Awa"), "child.dob": ("2001-02-03", None), "father.name": (None, None)}
    assert rows(files.metrics_csv(spark, f"{root}/batch.csv"), "doc_id") == [("d1",)] and files.metrics_csv(spark, f"{root}/batch.csv", None).count() == 2
    assert files.settings(spark, f"{root}/.env", {"A": "9", "Z": "0"}) == {"A": "9", "B": "two words", "C": "x"}
    assert files.images(spark, f"{root}/packs/zz").first().base64 == "bm8gcGFjaw=="


def test_writers(spark, tmp_path):
    wide = spark.createDataFrame([("d", "é")], "doc_id string, nom string")
    files.write_wide(wide, f"{tmp_path}/wide")
    assert spark.read.csv(f"{tmp_path}/wide", header=True).collect() == wide.collect()
    files.write_batch_csv(wide, f"{tmp_path}/batch", ["d"])
    assert files.metrics_csv(spark, f"{tmp_path}/batch", True).first().asDict() == {"doc_id": "d", "nom": "é", "handwritten": "True"}
    one = spark.createDataFrame([("d", "f", "c", "a", "b", "r", 1)], "doc_id string, field string, crop string, model_value string, corrected_value string, reviewer string, ts long")
    for _ in range(2):
        files.append_corrections(one, f"{tmp_path}/log")
    assert files.corrections(spark, f"{tmp_path}/log").count() == 2
    files.write_samples(spark.createDataFrame([("{}",)], "sample string"), f"{tmp_path}/s")
    assert spark.read.text(f"{tmp_path}/s").first().value == "{}"
    files.write_reports(one, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 1


def test_first_original(spark):
    df = spark.createDataFrame([("d", "/r/d/original.pdf"), ("d", "/r/d/original.png"), ("e", "/r/e/page.png")], "doc_id string, path string")
    assert rows(files.first_original(df), "doc_id", "path") == [("d", "/r/d/original.png")]


def test_retry_waits_as_told_and_gives_up_on_a_spent_quota():
    waits, answers = [], [edges.Busy(), edges.Busy(wait=500), "ok"]

    def call():
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert edges.with_retry(call, sleep=waits.append) == "ok" and waits == [2.0, 70.0]
    answers[:] = [edges.Busy(spent=True)]
    with pytest.raises(edges.Busy):
        edges.with_retry(call, sleep=waits.append)


def test_batches_of_calls_and_dry_run(spark):
    calls = spark.createDataFrame([("d", 0, "p"), ("d", 1, "q")], "doc_id string, batch int, prompt string")

    class Fails(edges.Recorded):
        def chat(self, prompt, images=(), system=None):
            if prompt == "q":
                raise ValueError("no answer")
            return super().chat(prompt)

    got = {r.batch: (r.answer, r.error) for r in edges.read_batches(calls, lambda: Fails({"p": "{}"}), 2).collect()}
    assert got == {0: ("{}", None), 1: (None, "no answer")}
    decl = spark.createDataFrame([("d", ("x",), ["a", "b"])], "doc_id string, child struct<dob:string>, comments array<string>")
    assert rows(edges.dry_run(decl), "payload", "comment") == [('{"child":{"dob":"x"}}', "a\nb")]
    keys = spark.createDataFrame([("a, b,,a",)], "keys string")
    assert edges.distinct_keys(keys).first()["keys"] == ["a", "b"]
    scans = spark.createDataFrame([("a.pdf", bytearray(b"p")), ("b.png", bytearray(b"i")), ("c.png", bytearray())], "path string, content binary")
    out = {r.path: (r.page and bytes(r.page), r.n_pages, r.error) for r in edges.render_pages(scans, lambda c: (b"page", 2)).collect()}
    assert out == {"a.pdf": (b"page", 2, None), "b.png": (b"i", 1, None), "c.png": (None, None, "empty file")}
