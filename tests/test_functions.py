import datetime as dt
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veracta.functions import dates, fuzzy, json_repair, metrics, text

short = st.text(alphabet="abcé' -", max_size=12)


def slow_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@given(short, short)
def test_lcs_is_the_table(a, b):
    assert fuzzy.lcs(a, b) == slow_lcs(a, b) == fuzzy.lcs(b, a)


@given(short, short)
def test_ratios_are_bounded_and_symmetric(a, b):
    for f in (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_set_ratio, fuzzy.token_sort_ratio, fuzzy.weighted_ratio):
        assert 0 <= f(a, b) <= 100 + 1e-9
        assert f(a, b) == pytest.approx(f(b, a))
    if a.strip():
        assert fuzzy.ratio(a, a) == fuzzy.partial_ratio(a, a) == 100


def test_ratio_is_indel_and_not_edit_distance():
    assert fuzzy.ratio("abcd", "abed") == 75.0
    assert fuzzy.ratio("", "") == 100.0


def test_partial_and_sets():
    assert fuzzy.partial_ratio("yamoussa", "xx yamoussa zz") == 100
    assert fuzzy.token_set_ratio("b a", "a b c") == 100
    assert fuzzy.cross_check("", "x") == 0


def test_places_with_small_errors_are_near_and_others_far():
    assert fuzzy.weighted_ratio("librevile", "libreville") >= 88
    assert fuzzy.weighted_ratio("port gentil", "port-gentil") >= 88
    assert fuzzy.weighted_ratio("qwrtzp", "libreville") < 88


def test_lcs_column_and_arrow_agree(spark):
    rows = [("abcbdab", "bdcaba"), ("", "x"), ("same", "same"), ("é à", "e a")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(fuzzy.ratio_column(F.col("a"), F.col("b")).alias("c"), fuzzy.similarity(F.col("a"), F.col("b")).alias("u")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        assert r.c == pytest.approx(fuzzy.ratio(a, b)) and r.u == pytest.approx(fuzzy.ratio(a, b))


def test_length_filter_loses_nothing():
    for a, b in (("abc", "abcd"), ("a", "aaaa"), ("", "x")):
        reach = 200 * min(len(a), len(b)) >= 80 * (len(a) + len(b))
        assert reach or fuzzy.ratio(a, b) < 80


def test_the_folding_table_is_the_decomposition():
    assert len(text.ACCENTED) == len(text.PLAIN)
    for a, p in zip(text.ACCENTED, text.PLAIN, strict=True):
        assert "".join(c for c in unicodedata.normalize("NFKD", a) if not unicodedata.combining(c)) == p


def test_normal_forms(one):
    assert one(text.normal, a="  ÉLÈVE\t d'Été ") == "eleve d'ete"
    assert one(text.normal_value, a="Port-Gentil. ") == "port gentil"
    assert one(text.normal, a=None) == ""
    assert one(text.strip_accents, a="Ça É") == "Ca E"


@pytest.mark.parametrize(
    "full, first, last",
    [("Awa NDIAYE", "Awa", "NDIAYE"), ("NDIAYE Awa Marie", "Awa Marie", "NDIAYE"), ("awa ndiaye", "awa", "ndiaye"), ("NDIAYE", "", "NDIAYE"), ("Awa", "Awa", ""), ("A B", "A", "B"), ("", "", ""), (None, "", ""), ("DE LA Awa", "Awa", "DE LA")],
)
def test_split_name(one, full, first, last):
    got = one(text.split_name, a=full)
    assert (got.firstname, got.surname) == (first, last)


def test_small_maps(one):
    assert one(text.gender, a=" FÉMININ ") == "female" and one(text.gender, a="x") is None
    assert one(text.relation, a="la mère du père") == "FATHER" and one(text.relation, a="Mère") == "MOTHER" and one(text.relation, a="oncle") is None
    assert one(text.nationality, a="Citoyenne Sénégalaise") == "SEN" and one(text.nationality, a="Somalienne") is None and one(text.nationality, a="congolais") is None
    assert one(text.slug, a="a b/c!") == "a_b_c" and one(text.slug, a="!!") == "scan" and len(one(text.slug, a="x" * 99)) == 40
    assert one(text.title, a="PORT-gentil d'été") == "Port-Gentil D'Été"
    assert one(text.name_key, a="b  A é") == "a b e"
    assert one(text.is_iso_date, a="2001-99-99") is True
    assert one(text.is_pdf, a="X.PDF") is True


def test_no_stem_begins_another():
    assert not [(a, b) for a in text.STEMS for b in text.STEMS if a != b and b.startswith(a)]


def test_substantial(one):
    assert one(lambda t, h: text.substantial(t, h), t="abc d3ef xy", h=50) is True
    assert one(lambda t, h: text.substantial(t, h), t="abc d3ef xy", h=90) is False


@pytest.mark.parametrize("said, n", [("mil neuf cent quatre-vingt-onze", 1991), ("deux mille", 2000), ("quatre vingt dix", 90), ("soixante-dix", 70), ("cent", 100), ("l'an deux mil dix", 2010), ("deux chats", None), ("", None), ("le", None), ("12", 12)])
def test_words_to_int(one, said, n):
    assert one(dates.words_to_int, a=said) == n


@pytest.mark.parametrize(
    "said, date",
    [
        ("2001-02-03", dt.date(2001, 2, 3)), ("2001-99-99", None), ("le 3/2/1999", dt.date(1999, 2, 3)), ("03.02.31", dt.date(1931, 2, 3)), ("03 02 30", dt.date(2030, 2, 3)), ("31/02/2000", None),
        ("1998/12/31", None), ("le douze mars mil neuf cent quatre-vingt-onze", dt.date(1991, 3, 12)), ("douze marz quatre vingt onze", None), ("cinq decembr deux mille", dt.date(2000, 12, 5)), ("mars", None), ("", None), (None, None),
    ],
)
def test_parse_date(one, said, date):
    assert one(dates.parse_date, a=said) == date


def test_dates_in_text(one):
    assert one(dates.dates_in_text, a="né le 1.2.1990, carte du 31/02/2000 et 3-4-2005") == [dt.date(1990, 2, 1), dt.date(2005, 4, 3)]
    assert one(dates.dates_in_text, a=None) == []


def test_id_birthdate(spark):
    rows = [("020399 77", "ddmmyy", dt.date(1999, 3, 2)), ("2 990302", "cyymmdd", dt.date(1999, 3, 2)), ("99-03-02", "yymmdd", dt.date(1999, 3, 2)), ("12", "ddmmyy", dt.date(1999, 3, 2)), ("999999", "yymmdd", dt.date(1999, 3, 2))]
    df = spark.createDataFrame(rows, "n string, f string, b date")
    got = [r.r for r in df.select(dates.id_birthdate(F.col("n"), F.col("f"), F.col("b")).alias("r")).collect()]
    assert [g and g.date for g in got] == [dt.date(1999, 3, 2)] * 3 + [None, None]
    assert got[3] is None and got[4].six == "999999"


@pytest.mark.parametrize(
    "broken, k",
    [
        ('{"k": 1}', 1), ('<think>{"k": 9}</think> ```json\n{"k": 1}\n```', 1), ('text {"k": 1} more', 1), ('{"k": 1,}', 1), ("{'k': 1}", 1), ('{"k": 1, "t": "a\nb"}', 1), ("[1]", None), ("3", None), ("nothing", None), ("", None), (None, None),
    ],
)
def test_json_repair(one, broken, k):
    assert one(lambda t: F.try_variant_get(json_repair.extract_json(t), "$.k", "int"), a=broken) == k


def test_newlines_are_escaped_in_strings_only(one):
    assert one(json_repair.escape_newlines, a='{\n"a": "x\ny", "b": "q\\"\nz"}') == '{\n"a": "x\\ny", "b": "q\\"\\nz"}'


@pytest.mark.parametrize(
    "given_, raw, value, sure",
    [('{"raw":"r","value":"v","confidence":0.9}', "r", "v", 0.9), ('{"value":"v"}', "", "v", 0.5), ('{"value":"v","confidence":null}', "", "v", 0.0), ('"x"', "x", "x", 0.5), ("7", "7", "7", 0.5), ("null", "", None, 0.0)],
)
def test_coerce(one, given_, raw, value, sure):
    got = one(lambda t: json_repair.coerce(F.parse_json(t)), a=given_)
    assert (got.raw, got.value, got.confidence) == (raw, value, sure)


def python_wer(p, r):
    row = list(range(len(r) + 1))
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(r, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1] / len(r)


def test_metrics(one):
    assert one(metrics.nls, p="Céline", r="CELINE") == 1.0
    assert one(metrics.nls, p="", r=None) == 1.0 and one(metrics.nls, p="a", r="") == 0.0
    assert one(metrics.anls, p="abcd", r="axyz") == 0.0 and one(metrics.anls, p="abcd", r="abcx") == 0.75
    assert one(metrics.cer, p="abcdef", r="ab") == 2.0 and one(metrics.cer, p="", r="") == 0.0 and one(metrics.cer, p="x", r="") == 1.0
    p, r = "le chat noir dort", "le chien noir dort bien"
    assert one(metrics.wer, p=p, r=r) == python_wer(p.split(), r.split())
    assert one(metrics.rouge_l, p=p, r=r) == pytest.approx(2 * (3 / 4) * (3 / 5) / (3 / 4 + 3 / 5))
    assert one(metrics.rouge_l, p="", r="x") == 0.0


def test_bleu_smooths_missing_orders(one):
    assert one(metrics.bleu, p="a", r="a") == pytest.approx((1 / 2) ** 0.75)
    assert one(metrics.bleu, p="a b", r="a c") == pytest.approx((2 / 3 * 1 / 2 * 1 / 2 * 1 / 2) ** 0.25)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(short, short), min_size=1, max_size=8))
def test_anls_is_bounded(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, r string").select(metrics.anls(F.col("p"), F.col("r")).alias("a"))
    assert all(0 <= x.a <= 1 for x in df.collect())
