import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from veracta.operators import checks, consensus, evaluation, grounding, layout, mapping, review


def rows(df, *order):
    return sorted(tuple(r) for r in (df.select(*order) if order else df).collect())


# --- consensus and score ---------------------------------------------------------------------------------------------


@pytest.fixture
def merged(spark):
    fields = spark.createDataFrame([("d", i, f, "text", r) for i, (f, r) in enumerate([("same", "a"), ("differ", "b"), ("crop_null", "c"), ("page_only", "page"), ("absent", "e"), ("stub", "f")])], "doc_id string, ord int, field string, type string, region string")
    page = spark.createDataFrame([("d", "same", "x", "Jean-Paul", 0.9), ("d", "differ", "x", "abc", 0.8), ("d", "crop_null", "x", "v", 1.0), ("d", "page_only", "x", "p", 0.6), ("d", "stub", "x", "s", 0.8)], "doc_id string, field string, raw string, value string, confidence double")
    crop = spark.createDataFrame([("d", "same", "y", "jean paul", 1.0, None), ("d", "differ", "y", "xyz", 1.0, None), ("d", "crop_null", "", None, 0.2, None), ("d", "stub", "", None, 0.0, "failed")], "doc_id string, field string, raw string, value string, confidence double, error string")
    boxes = spark.createDataFrame([("d", "a", [1, 2, 3, 4], "a.png", False), ("d", "b", [1, 2, 3, 4], "b.png", True)], "doc_id string, region string, bbox array<int>, crop_path string, interpolated boolean")
    return lambda **kw: {r.field: r for r in consensus.merge(fields, page, crop, boxes, **kw).collect()}


def test_merge(merged):
    got = merged()
    assert (got["same"].value, got["same"].agreement, got["same"].source, got["same"].model_confidence) == ("jean paul", True, "crop", 0.95)
    assert (got["differ"].value, got["differ"].agreement, got["differ"].anchor_interpolated) == ("xyz", False, True)
    assert (got["crop_null"].value, got["crop_null"].source, got["crop_null"].agreement, got["crop_null"].model_confidence) == ("v", "page", None, 0.6)
    assert (got["page_only"].value, got["page_only"].agreement, got["page_only"].bbox) == ("p", None, None)
    assert (got["absent"].value, got["absent"].raw, got["absent"].model_confidence) == (None, "", 0.0)
    assert got["stub"].model_confidence == 0.4 and merged(skip_stubs=True)["stub"].model_confidence == 0.8
    assert merged(crops_read=False)["same"].anchor_interpolated is True


def score(conf, agree, interp, value, ok, warn, fail):
    """The published formula, in plain arithmetic."""
    s = 0.5 * (conf or 0) + 0.3 * {None: 0.5, True: 1.0, False: 0.0}[agree] + 0.2 * (0.0 if fail else 1.0 if ok and not warn else 0.5)
    s -= 0.08 if interp else 0
    s -= 0.15 if warn else 0
    s = min(s, 0.4) if fail else s
    s = min(s, 0.3) if not value else s
    return max(0.0, min(1.0, s))


def test_score_is_the_formula(spark):
    rng = random.Random(1)
    cases = [(i, rng.choice([None, 0.0, 0.5, 0.93, 1.0]), rng.choice([None, True, False]), rng.choice([None, True, False]), rng.choice([None, "", "v"]), *(rng.random() < 0.4 for _ in range(3))) for i in range(200)]
    df = spark.createDataFrame(cases, "i int, conf double, agree boolean, interp boolean, value string, ok boolean, warn boolean, fail boolean")
    got = df.select("i", consensus.raw_score(*(F.col(c) for c in ("conf", "agree", "interp", "value", "ok", "warn", "fail"))).alias("s")).collect()
    for r in got:
        assert r.s == pytest.approx(score(*cases[r.i][1:]), abs=1e-12)
    # where the readings disagree, no field is accepted: an identity, not a measurement
    assert all(r.s < consensus.HIGH for r in got if cases[r.i][2] is False)


def test_the_edge_of_the_upper_band(one):
    s = one(lambda c: consensus.raw_score(c, F.lit(None).cast("boolean"), F.lit(False), F.lit("v"), F.lit(True), F.lit(False), F.lit(False)), c=1.0)
    assert s >= 0.85


def test_findings_are_nested_and_reported(spark):
    m = spark.createDataFrame([("d", 0, "a", "v", 1.0, True, False), ("d", 1, "b", None, 1.0, None, False)], "doc_id string, ord int, field string, value string, model_confidence double, agreement boolean, anchor_interpolated boolean")
    f = spark.createDataFrame([("d", 0, "a", "ok", "m"), ("d", 1, "a", "warn", "n")], "doc_id string, ord int, field string, level string, message string")
    got = {r.field: r for r in consensus.score(m, f).collect()}
    assert [x.level for x in got["a"].findings] == ["ok", "warn"] and got["a"].score == 0.75 and got["a"].band == "medium"
    assert got["b"].score == 0.3 and got["b"].band == "low"
    rep = consensus.report(consensus.score(m, f)).first()
    assert (rep.fields_total, rep.fields_auto_accepted, rep.fields_for_review, rep.status) == (2, 0, ["a", "b"], "needs_review")


def test_batches_and_last_write(spark):
    df = spark.createDataFrame([("d", i) for i in range(12)], "doc_id string, ord int")
    assert [r.batch for r in consensus.batches(df).orderBy("ord").collect()] == [0] * 5 + [1] * 5 + [2] * 2
    obs = spark.createDataFrame([("d", "a", "", "1", 1.0, None, 1), ("d", "a", "", "2", 1.0, None, 2), ("d", "a", "", None, 0.0, "e", 3), ("d", "b", "", None, 0.0, "e1", 1), ("d", "b", "", None, 0.0, "e2", 2)], "doc_id string, field string, raw string, value string, confidence double, error string, batch int")
    assert rows(consensus.last_write(obs).select("field", F.coalesce("value", "error"))) == [("a", "2"), ("b", "e1")]


# --- rules -----------------------------------------------------------------------------------------------------------


GOOD = {"sexe": "Féminin", "nom": "NDIAYE", "date_naissance": "2001-02-03"}
CARD = GOOD | {"pere_cnin": "n° 12 du 01.02.1970", "pere_date_naissance": "1970-02-01"}
YEAR = GOOD | {"date_acte": "2001-03-01", "reference": "12/2002"}
WORDS = GOOD | {"numero_acte_lettres": "numéro: cent vingt", "numero_acte_marge": "n° 120"}
DECLARED = GOOD | {"annee": "2001", "date_declaration": "2001-03-01"}
PAIR = GOOD | {"a": "Moussa Ba", "b": "MOUSSA BA"}

#: Fields, what the pack asks for, findings that must be there, and fields that must have none.
RULES = {
    "good": (GOOD, {}, {("sexe", "ok")}, {"date_naissance", "nom"}),
    "sex": (GOOD | {"sexe": "?"}, {}, {("sexe", "fail")}, set()),
    "nothing": ({}, {}, {("enfant_nom", "warn"), ("date_naissance", "warn"), ("sexe", "warn")}, set()),
    "empty": ({"nom": ("", "")}, {}, {("nom", "warn")}, {"enfant_nom"}),
    "unread": (GOOD | {"date_naissance": "illisible"}, {}, {("date_naissance", "warn")}, set()),
    "raw": (GOOD | {"date_naissance": ("?", "le 3/2/2001"), "date_acte": "2001-02-10"}, {}, {("date_naissance", "ok")}, set()),
    "order": (GOOD | {"date_enregistrement": "2000-01-01"}, {}, {("date_naissance", "fail")}, set()),
    "late": (GOOD | {"date_declaration": "2010-01-01"}, {}, {("date_declaration", "warn")}, {"date_naissance"}),
    "in time": (GOOD | {"date_acte": "2001-02-10"}, {}, {("date_naissance", "ok")}, {"date_acte"}),
    "young": (GOOD | {"pere_date_naissance": "1995-01-01"}, {}, {("pere_date_naissance", "warn")}, set()),
    "card": (CARD, {}, {("pere_cnin", "ok")}, set()),
    "card not asked": (CARD, {"cnin_date": False}, set(), {"pere_cnin"}),
    "card differs": (CARD | {"pere_date_naissance": "1971-02-01"}, {}, {("pere_cnin", "warn")}, set()),
    "year": (YEAR, {"reference_year": True}, {("reference", "warn")}, set()),
    "year not asked": (YEAR, {}, set(), {"reference"}),
    "id": (GOOD | {"nid_numero": "030201 12", "enfant_nid": "999999"}, {"id_birthdate_format": "ddmmyy"}, {("nid_numero", "ok")}, {"enfant_nid"}),
    "id differs": (GOOD | {"nid_numero": "040201 12"}, {"id_birthdate_format": "ddmmyy"}, {("nid_numero", "warn")}, set()),
    "id is no date": (GOOD | {"nid_numero": "999999", "enfant_nid": "030201"}, {"id_birthdate_format": "ddmmyy"}, {("nid_numero", "warn"), ("enfant_nid", "ok")}, set()),
    "margin": (GOOD | {"date_marge": "3/2/2001"}, {"margin_date_matches_birth": True}, {("date_marge", "ok")}, set()),
    "words": (WORDS, {"acte_number_words": True}, {("numero_acte_lettres", "ok")}, set()),
    "words differ": (WORDS | {"numero_acte_marge": "121"}, {"acte_number_words": True}, {("numero_acte_lettres", "warn")}, set()),
    "declared": (DECLARED, {"annee_matches_declaration": True}, {("annee", "ok")}, set()),
    "declared oddly": (DECLARED | {"annee": "MMI"}, {"annee_matches_declaration": True}, {("annee", "warn")}, set()),
    "pair": (PAIR, {"equal_pairs": [["a", "b"]]}, {("a", "ok")}, set()),
    "pair differs": (PAIR | {"b": "Awa"}, {"equal_pairs": [["a", "b"]]}, {("a", "warn")}, set()),
    "place": (GOOD | {"lieu_naissance": "Villneuve"}, {}, {("lieu_naissance", "ok")}, set()),
    "no place": (GOOD | {"lieu_naissance": "Qwrtz"}, {}, {("lieu_naissance", "warn")}, set()),
}


@pytest.fixture(scope="module")
def found(spark):
    kinds = f"doc_id string, fields map<string,struct<value:string,raw:string>>, places array<string>, checks {checks.CHECKS}"
    names = [c.split(":")[0] for c in checks.CHECKS[len("struct<") : -1].replace("array<array<string>>", "x").split(",")]
    records = [(k, {n: (v if isinstance(v, tuple) else (v, v)) for n, v in fields.items()}, ["Villeneuve", "Autre"], tuple(asked.get(n) for n in names)) for k, (fields, asked, _, _) in RULES.items()]
    out = {k: set() for k in RULES}
    for r in checks.findings(spark.createDataFrame(records, kinds)).collect():
        out[r.doc_id].add((r.field, r.level))
    return out


@pytest.mark.parametrize("case", RULES)
def test_rules(found, case):
    _, _, there, silent = RULES[case]
    assert there <= found[case]
    assert not [f for f in found[case] if f[0] in silent]


@pytest.mark.parametrize(("strict", "want"), [(False, "Villeneuve"), (True, None)])
def test_a_pack_without_places_takes_those_of_the_fallback(spark, strict, want):
    rows = [(1, {"lieu_naissance": ("VILLENEUVE", "")}, []), (2, {"lieu_naissance": ("VILLENEUVE", "")}, ["Autre"])]
    records = spark.createDataFrame(rows, "doc_id long, fields map<string,struct<value:string,raw:string>>, places array<string>")
    got = {r.doc_id: r.place for r in checks.best_places(records, ["Villeneuve"], strict).collect()}
    assert got == {1: want, 2: None}


def test_a_place_is_put_into_its_known_form_for_scoring_only(spark):
    m = spark.createDataFrame([("d", "lieu_naissance", "Villneuve"), ("d", "x", "y")], "doc_id string, field string, value string")
    known = spark.createDataFrame([("d", "lieu_naissance", "Villeneuve")], "doc_id string, field string, place string")
    assert rows(checks.canonical(m, known), "field", "value", "value_read") == [("lieu_naissance", "Villeneuve", "Villneuve"), ("x", "y", "y")]


# --- mapping ---------------------------------------------------------------------------------------------------------


@pytest.fixture
def declared(spark):
    def run(fields, **kw):
        df = spark.createDataFrame([("d", {k: (v, 0.9) if isinstance(v, str) else v for k, v in fields.items()}, list(fields))], "doc_id string, fields map<string,struct<value:string,score:double>>, names array<string>")
        return mapping.mapped(df, **kw).first()

    return run


def test_names_and_aliases(declared):
    got = declared({"nom": "DIOP", "prenoms": "Awa"})
    assert (got.child.name.firstname, got.child.name.surname) == ("Awa", "DIOP")
    got = declared({"pere_nom": "Moussa BA", "mere_nom_famille": "SY", "mere_nom": "ignored"})
    assert (got.father.name.firstname, got.father.name.surname) == ("Moussa", "BA")
    assert (got.mother.name.firstname, got.mother.name.surname) == ("", "SY") and got.child.name is None and got.comments == []


def test_low_scores_are_taken_and_flagged(declared):
    got = declared({"sexe": ("F", 0.5), "date_naissance": ("2001-02-03", 0.59), "lieu_naissance": "Ici"})
    assert got.child.gender == "female" and got.child.dob == "2001-02-03" and len(got.comments) == 3


def test_what_fails_a_format_is_lost_unless_strict(declared):
    lost = {"date_naissance": "3 mars", "sexe": "?"}
    assert declared(lost).comments == [] and len(declared(lost, strict=True).comments) == 2


def test_declarant_and_the_rest(declared):
    got = declared({"declarant": ("la mère", 0.1), "pere_nationalite": "Martien", "autre": "x"})
    assert got.informant.relation == "MOTHER"
    assert sorted(c.split(" (")[0] for c in got.comments) == ["autre", "pere_nationalite"]


def test_places_are_resolved_once_sure(spark):
    d = spark.createDataFrame([("a", "dakar", "SN"), ("b", "x", "SN"), ("c", "dakar", "??")], "doc_id string, place string, country string")
    r = spark.createDataFrame([("dakar", "SN", "DAKAR-plateau", 0.9), ("x", "SN", "X", 0.6)], "place string, country string, name string, confidence double")
    c = spark.createDataFrame([("SN", "SEN")], "country string, iso3 string")
    got = {x.doc_id: x.birth_place for x in mapping.with_places(d, r, c).collect()}
    assert got["a"].name == "Dakar-Plateau" and got["a"].iso3 == "SEN" and got["b"] is None and got["c"] is None


# --- layout ----------------------------------------------------------------------------------------------------------


def test_gap_clusters(spark):
    df = spark.createDataFrame([("d", x) for x in (0, 10, 100, 105, 300)], "doc_id string, x int")
    assert [r.cluster for r in layout.gap_clusters(df, "doc_id", "x", F.lit(50)).orderBy("x").collect()] == [0, 0, 1, 1, 2]


def test_longest_run_in_order(spark):
    df = spark.createDataFrame([("d", i, y) for i, y in enumerate([10, 50, 20, 20, 5, 30])] + [("e", 0, 9), ("e", 1, 1)], "doc_id string, ord int, y int")
    assert rows(layout.in_order(df)) == [("d", 0, 10), ("d", 2, 20), ("d", 3, 20), ("d", 5, 30), ("e", 0, 9), ("e", 1, 1)]


def test_greedy_takes_the_best_first_and_each_place_once(spark):
    df = spark.createDataFrame([("d", "Date", 0, 1, 94.0, 0, 5, 50, 9), ("d", "ACTE", 1, 1, 100.0, 0, 5, 50, 9), ("d", "Date", 0, 2, 90.0, 0, 30, 50, 9), ("d", "Date", 0, 3, 89.0, 0, 60, 50, 9)], "doc_id string, label string, label_ord int, line_id int, score double, x int, y int, w int, h int")
    need = spark.createDataFrame([("Date", 1), ("ACTE", 1)], "label string, needed int")
    assert rows(layout.greedy(df, need).select("label", "line_id")) == [("ACTE", 1), ("Date", 2)]


def test_candidates_find_a_label_inside_a_noisy_line(spark):
    words = spark.createDataFrame([("d", 1, x, 10, 30, 10, t, 90.0) for x, t in ((0, "zz"), (40, "Nom"), (80, "du"), (120, "pere"), (160, "qq"))] + [("d", 2, 0, 40, 30, 10, "autre", 90.0), ("d", 2, 50, 40, 5, 5, "?", 3.0)], "doc_id string, line_id int, x int, y int, w int, h int, text string, confidence double")
    page = layout.lines(layout.seen_words(words))
    labels = spark.createDataFrame([("Nom du père", 0)], "label string, label_ord int")
    got = layout.candidates(page, labels).collect()
    assert [(g.line_id, g.text, g.score, g.x, g.w) for g in got] == [(1, "Nom du pere", 100.0, 40, 110)]


def test_form_column_keeps_one_copy(spark):
    found = spark.createDataFrame([("d", lab, x) for x in (10, 800) for lab in "abcd"] + [("e", lab, 10) for lab in "abcd"] + [("e", "a", 900)], "doc_id string, label string, x int")
    pages = spark.createDataFrame([("d", 1000), ("e", 1000)], "doc_id string, page_w int")
    ink = spark.createDataFrame([("d", 0, 0.1), ("d", 1, 0.5)], "doc_id string, col int, ink_ratio double")
    got = layout.form_column(found, pages, ink)
    assert rows(got.groupBy("doc_id", "x").count()) == [("d", 800, 4), ("e", 10, 4)]



def test_fitted_line_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(5)
    points = [(rng.randint(90_000, 10_500_000) / 100, float(rng.randint(1, 50))) for _ in range(38)]
    rows = [(doc, y, x) for doc in range(60) for y, x in rng.sample(points, len(points))]
    a = spark.createDataFrame([(d, y, x, y, x) for d, y, x in rows], "doc_id int, y double, rel_y double, x double, h double").repartition(7)
    found = {(r.slope, r.intercept, r.residual) for r in layout.fit(a).collect()}
    x, y = [Fraction(str(p[1])) for p in points], [Fraction(str(p[0])) for p in points]
    mx, my = sum(x) / 38, sum(y) / 38
    slope = sum((u - mx) * (v - my) for u, v in zip(x, y, strict=True)) / sum((u - mx) ** 2 for u in x)
    away = sorted(abs(slope * u + my - slope * mx - v) for u, v in zip(x, y, strict=True))
    assert len(found) == 1 and found.pop() == pytest.approx((float(slope), float(my - slope * mx), float((away[18] + away[19]) / 2)), rel=1e-15)


def test_line_without_a_slope(spark):
    rows = [(1, 5.0, 2.0), (2, 5.0, 0.1), (2, 6.0, 0.1), (2, 9.0, 0.1), (3, None, 1.0), (3, 4.0, None), (None, 1.0, 1.0), (4, 1.0, 1.0), (4, 3.0, 2.0), (4, None, 5.0)]
    a = spark.createDataFrame([(d, y, x, y, x) for d, y, x in rows], "doc_id int, y double, rel_y double, x double, h double")
    got = {r.doc_id: (r.slope, r.intercept, r.points, r.n_found, r.residual) for r in layout.fit(a).collect()}
    assert got == {1: (None, None, 1, 1, 0.0), 2: (None, None, 3, 3, 0.0), 3: (None, None, 1, 2, 0.0), 4: (2.0, -1.0, 3, 3, 0.0)}


def test_fit_interpolation_and_boxes(spark):
    a = spark.createDataFrame([("d", "a", 100, 100, 50, 20, 0.1), ("d", "b", 104, 200, 50, 20, 0.2), ("d", "c", 102, 300, 50, 20, 0.3)], "doc_id string, id string, x int, y int, w int, h int, rel_y double")
    line = layout.fit(a)
    got = line.first()
    assert got.slope == pytest.approx(1000) and got.residual == pytest.approx(0, abs=1e-6) and got.left == 100 and got.median_h == 20
    t = spark.createDataFrame([("a", "A", 0.1), ("d", "Dddd", 0.45)], "id string, label string, rel_y double")
    made = layout.interpolated(a, t, line)
    assert rows(made.where("interpolated").select("id", "x", "y", "w", "h"))[0][:2] == ("d", 100)
    fields = spark.createDataFrame([("f", "right_of", "a", "b", None, None), ("g", "band", "b", "none", True, 0), ("h", "band", "zz", "a", True, 0)], "field string, kind string, anchor string, until string, include_anchor_line boolean, pad int")
    pages = spark.createDataFrame([("d", 1000, 800)], "doc_id string, page_w int, page_h int")
    boxes = {r.field: (r.x, r.y, r.w, r.h) for r in layout.field_boxes(made, fields, pages).collect()}
    assert boxes["f"] == (150, 82, 88, 120) and boxes["g"] == (100, 188, 134, 92)
    cov = layout.coverage(a, fields).first().coverage
    assert cov == pytest.approx(2 / 3)


def test_templates_countries_and_rotation(spark):
    page = spark.createDataFrame([("d", 1, 5, "ACTE de Naissance"), ("e", 1, 5, "rien")], "doc_id string, line_id int, y int, text string")
    t = spark.createDataFrame([("t1", 1, "volet"), ("t2", 2, "acte"), ("t3", 3, None)], "template_id string, ord int, keyword string")
    assert rows(layout.detect_template(page, t)) == [("d", "t2"), ("e", "t3")]
    packs = spark.createDataFrame([("aa", 1, ["acte", "ACTE"]), ("bb", 2, ["acte", "naissance"])], "country string, ord int, keywords array<string>")
    assert rows(layout.detect_country(page, packs)) == [("d", "aa", 2), ("e", "zz", 0)]
    y = spark.createDataFrame([("d", 0, 0, 30), ("d", 1, 90, 60), ("e", 0, 0, 160), ("e", 1, 90, 900), ("f", 0, 0, 39), ("f", 1, 180, 40)], "doc_id string, ord int, rotation int, chars int")
    assert rows(layout.best_rotation(y)) == [("d", 90), ("e", 0), ("f", 0)]


# --- grounding -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("box, want", [([100.0, 100.0, 200.0, 300.0], (100, 100, 200, 100)), ([0.0, 0.0, 1000.0, 1000.0], None), ([0.0, 0.0, 5.0, 500.0], None), ([0.0, 0.0, 100.0], None), ([-50.0, -50.0, 100.0, 2000.0], (0, 0, 1000, 100)), (None, None)])
def test_scale_box(spark, box, want):
    df = spark.createDataFrame([(box,)], "b array<double>").select(grounding.scale_box(F.col("b"), F.lit(1000), F.lit(1000)).alias("r"))
    got = df.first().r
    assert (got and tuple(got)) == want


def test_audit_statuses_and_quorum(spark):
    words = spark.createDataFrame([("d", x, y, 40, 10, t) for y, line in ((100, "nom prenom enfant"), (300, "date lieu naissance")) for x, t in zip((100, 150, 200), line.split(), strict=True)], "doc_id string, x int, y int, w int, h int, text string")
    regions = spark.createDataFrame([("d", r, i) for i, r in enumerate("abcde")], "doc_id string, region string, ord int")
    top, low = [90.0, 90.0, 130.0, 300.0], [290.0, 90.0, 330.0, 300.0]
    claims = spark.createDataFrame([("d", "a", top, "Nom prénom enfant"), ("d", "b", low, "qqq www zzz kkk"), ("d", "c", [500.0, 100.0, 600.0, 300.0], "texte"), ("d", "d", [0.0, 0.0, 1.0, 1.0], "x")], "doc_id string, region string, box array<double>, text string")
    pages = spark.createDataFrame([("d", 1000, 1000)], "doc_id string, page_w int, page_h int")
    out = grounding.audit(regions, claims, words, pages)
    assert rows(out.select("region", "status")) == [("a", "verified"), ("b", "dropped_contradicted"), ("c", "unverified"), ("d", "dropped_sanity"), ("e", "missing_from_response")]
    q = grounding.quorum(out).first()
    assert (q.requested, q.kept, q.verified, q.accepted) == (5, 2, 1, False)
    assert grounding.audit(regions, claims, words, pages, "refine_").where("status = 'refine_verified'").count() == 1


def test_strips_and_best_attempt(spark):
    regions = spark.createDataFrame([("d", r, i) for i, r in enumerate("ab")], "doc_id string, region string, ord int")
    pages = spark.createDataFrame([("d", 100, 1000)], "doc_id string, page_w int, page_h int")
    assert rows(grounding.strips(regions, pages)) == [("d", "a", 0, 650), ("d", "b", 350, 1000)]
    tries = spark.createDataFrame([("d", 1, True), ("d", 1, False), ("d", 2, True), ("d", 2, False), ("d", 3, False)], "doc_id string, attempt int, kept boolean")
    assert {r.attempt for r in grounding.best_attempt(tries).collect()} == {1}


# --- review and evaluation -------------------------------------------------------------------------------------------


def test_changes_are_what_differs_and_repeat_to_nothing(spark):
    fields = spark.createDataFrame([("d", "a", "c", "1"), ("d", "b", None, None), ("d", "e", None, "")], "doc_id string, field string, crop string, value string")
    edits = spark.createDataFrame([("d", "a", "2", "r", 1), ("d", "b", "", "r", 1), ("d", "e", None, "r", 1)], "doc_id string, field string, value string, reviewer string, ts int")
    got = review.changes(fields, edits)
    assert rows(got, "field", "model_value", "corrected_value") == [("a", "1", "2")]
    again = fields.join(edits.select("doc_id", "field", F.col("value").alias("n")), ["doc_id", "field"]).select("doc_id", "field", "crop", F.col("n").alias("value"))
    assert review.changes(again, edits).count() == 0


def test_overrides_columns_and_wide(spark):
    fields = spark.createDataFrame([("d", "b", 0, "1"), ("d", "a", 1, "2"), ("e", "z", 0, "3")], "doc_id string, field string, ord int, value string")
    fixed = spark.createDataFrame([("d", "b", "9")], "doc_id string, field string, value string")
    reports = spark.createDataFrame([("d", "needs_review"), ("e", "auto_accepted")], "doc_id string, status string")
    out = review.overridden(fields, fixed, reports)
    assert rows(out, "doc_id", "field", "status") == [("d", "a", "corrected"), ("d", "b", "corrected"), ("e", "z", "auto_accepted")]
    assert review.column_order(out) == ["b", "a", "z"]
    assert {tuple(r) for r in review.wide(out).collect()} == {("d", "corrected", "9", "", ""), ("e", "auto_accepted", "", "", "3")}


def test_samples_are_json(spark):
    import json

    log = spark.createDataFrame([("c.png", "nom", 'a "b"'), (None, "nom", "x"), ("c", "nom", "")], "crop string, field string, corrected_value string")
    got = [json.loads(r.sample) for r in review.sft(log).collect()]
    assert len(got) == 1 and got[0]["messages"][1] == {"role": "assistant", "content": 'a "b"'} and got[0]["messages"][0]["content"][0] == {"type": "image", "image": "c.png"}


def test_corrections_count_once(spark):
    log = spark.createDataFrame([("a", 1, "f", "x", "y"), ("b", 2, "f", "x", "y"), ("b", 3, "f", "x\n y", "x y"), ("b", 4, "f", None, "z")], "doc_id string, ord int, field string, model_value string, corrected_value string")
    got = review.corrections_quality(log).first()
    assert (got.reviewed, got.wrong, got.error_pct, got.docs_touched) == (3, 2, 66.7, 2)


def test_job_status(spark):
    log = spark.createDataFrame([("a", 1, "[1] start"), ("a", 2, "x"), ("b", 1, "p"), ("b", 2, " "), ("b", 3, "q"), ("b", 4, "r"), ("b", 5, "s")], "job_id string, ord int, line string")
    jobs = spark.createDataFrame([("a", None, False, True), ("b", 1, False, True), ("c", 0, True, True), ("d", 0, False, True), ("e", None, False, False)], "job_id string, exit_code int, report_ready boolean, known boolean")
    got = {r.job_id: (r.status, r.stage) for r in review.job_status(log, jobs).collect()}
    assert got == {"a": ("running", "[1] start"), "b": ("error", "q | r | s"), "c": ("done", ""), "d": ("done_no_report", ""), "e": ("unknown", "")}


def test_uploads(one):
    assert one(lambda n, s: review.upload_reason(n, s), n="a.JPG", s=5) is None
    assert one(lambda n, s: review.upload_reason(n, s), n="a.exe", s=5) == "suffix"
    assert one(lambda n, s: review.upload_reason(n, s), n="a.pdf", s=0) == "empty"
    assert one(lambda n, s: review.upload_reason(n, s), n="a.pdf", s=1 << 30) == "too large"


def test_evaluation(spark):
    truth = spark.createDataFrame([("d", "child.name", "Awa DIOP", "Awa", "DIOP"), ("d", "child.dob", "2001-02-03", None, None), ("d", "child.gender", None, None, None), ("d", "father.occupation", "pêcheur", None, None)], "doc_id string, field string, ref string, ref_first string, ref_last string")
    pred = spark.createDataFrame([("d", "child.name", "DIOP Awa", "DIOP", "Awa"), ("d", "child.dob", "2001-02-04", None, None), ("d", "child.gender", "male", None, None)], "doc_id string, field string, pred string, pred_first string, pred_last string")
    rows_ = evaluation.entries(truth, pred)
    got = {r.field: r for r in rows_.collect()}
    assert got["child.name"].exact and got["child.name"].split_ok is False and got["child.dob"].fuzzy and got["child.gender"].hallucinated
    a = evaluation.aggregate(rows_).first()
    assert (a.fields_expected, a.fields_predicted, a.coverage, a.hallucination_rate, a.name_split_accuracy) == (3, 3, pytest.approx(2 / 3), 1.0, 0.0)
    assert a.exact_f1 == pytest.approx(1 / 3) and a.anls == pytest.approx((1 + 0.9) / 3)
    assert {r.field for r in evaluation.errors(rows_).collect()} == {"child.dob", "father.occupation"}
    assert [r.field for r in evaluation.swapped(rows_).collect()] == ["child.name"]


def test_confusion_without_counts_is_null(spark):
    df = spark.createDataFrame([(0, 0, 3, 1)], "tp int, fp int, fn int, tn int")
    got = evaluation.confusion(df).first()
    assert got.precision is None and got.recall == 0.0 and got.f1 is None and got.accuracy == 0.25
